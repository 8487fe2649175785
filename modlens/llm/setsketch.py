"""Near duplicates by SetSketch registers (Ertl, VLDB 2021).

*Sketch.*  A text's set is its distinct word shingles.  Every shingle is the seed of a Poisson
process whose points fall on ``registers`` registers; a register keeps the smallest point
of the set as floor(1 - log_b(point)), an exponentially spaced, truncated minimum.  The
sketch of a union is the register-wise maximum, and two sets agree in a register with about
the probability of their Jaccard similarity.

*Candidates.*  ``rows`` registers make a band; texts that agree in a band meet.  With 50 bands
of 7 a pair at similarity 0.8 meets nowhere with a chance of 8 in a million.

*Linking without all pairs.*
1. Texts with equal sets are one class; the smallest id stands for it.
2. In each bucket every member meets the smallest id of the bucket, the leader.  The
   similarity is estimated from the registers by maximum likelihood (the sizes are known);
   pairs estimated within five standard errors of the threshold are verified on full sets.
3. Links give components.  Only buckets that still hold several components without their
   leader go on: there, members outside the bucket's largest component meet the rest in
   blocks that are estimated and verified inside a task; just links that join two
   components leave it.

So a large group of copies costs its size, not its square; no bucket is capped.

Edge cases: a null or empty text has an empty set, which is linked with nothing; a null id is
compared with nothing and has a null component; rows that repeat an id are one document
with several texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.base import id_text, map_batches, slices, written
from modlens.llm.components import components
from modlens.llm.words import hash_words, mix64, window_hashes, word_codes

BASE, RATE, TOP = 1.001, 20.0, 65535
BLOCK = 256


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased); fewer than k words are one shingle."""
    codes, offsets, values = word_codes(texts, lower=True)
    h = hash_words(values)[codes]
    grams = window_hashes(h, k)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], b - a, salt=int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Registers of each set, one row of ``m`` a set; an empty set has zeros."""
    out = np.zeros((len(sets), m), np.uint16)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    reach = np.log(m) + 4.0                # how far the processes are followed; most sets are complete there
    while len(todo):
        size = np.array([len(sets[i]) for i in todo])
        seed = mix64(np.concatenate([sets[i] for i in todo]))
        of = np.repeat(np.arange(len(todo)), size)
        limit = np.repeat(reach / size, size)
        least = np.full(len(todo) * m, np.inf)
        at, j = np.zeros(len(seed)), 0
        while len(seed):
            width = int(np.clip((1 << 18) // len(seed), 1, 256))
            step = np.arange(j, j + width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            r = mix64(seed[:, None] + step[None, :])
            gap = -np.log(((r >> np.uint64(40)).astype(np.float64) + 0.5) / (1 << 24)) / m
            x = at[:, None] + np.cumsum(gap, axis=1)
            hit = x <= limit[:, None]
            where = of[:, None] * m + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(least, where[hit], x[hit])
            at, j = x[:, -1], j + width
            on = at <= limit
            seed, of, limit, at = seed[on], of[on], limit[on], at[on]
        least = least.reshape(len(todo), m)
        done = np.isfinite(least).all(axis=1)
        value = np.floor(1.0 - np.log(least[done] / RATE) / np.log(BASE))
        out[todo[done]] = np.clip(value, 0, TOP)
        todo, reach = todo[~done], reach * 2
    return out


def likely_similarity(plus: np.ndarray, minus: np.ndarray, equal: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from how many registers of u are above, below
    and equal to those of v, and the sizes of the sets.  The likelihood is concave."""
    u = n_u / (n_u + n_v)
    v = 1.0 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1.0) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        above, below = p(u - v * j), p(v - u * j)
        return plus * np.log(above) + minus * np.log(below) + equal * np.log(np.maximum(1.0 - above - below, 1e-12))

    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = value(a) < value(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def worth_verifying(u: np.ndarray, v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of registers may belong to sets of similarity ``least``: sizes, then the estimate."""
    near = np.minimum(n_u, n_v) >= least * np.maximum(n_u, n_v)
    i = np.flatnonzero(near)
    if len(i):
        a, b = np.broadcast_to(u, (len(near), u.shape[-1]))[i], np.broadcast_to(v, (len(near), v.shape[-1]))[i]
        plus, equal = (a > b).sum(axis=1), (a == b).sum(axis=1)
        m = a.shape[1]
        margin = 5.0 * np.sqrt(least * (1.0 - least) / m)
        size = lambda n: np.broadcast_to(n, near.shape)[i].astype(float)
        near[i] = likely_similarity(plus, m - plus - equal, equal, size(n_u), size(n_v)) >= least - margin
    return near


def sketches(texts: DataFrame, k: int, m: int) -> DataFrame:
    """Size, identity (128 bits) and registers of each document's set."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 1):
            sets = shingle_sets(part.column(1), k)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            first: dict[bytes, int] = {}
            own = [first.setdefault(key, len(first)) for key in keys]
            distinct = [None] * len(first)
            for o, s in zip(own, sets):
                distinct[o] = s
            made = sketch(distinct, m)
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()),
                 pa.array([made[o].tobytes() for o in own], pa.binary())],
                names=["doc_id", "n", "k1", "k2", "registers"])

    return map_batches(texts, one, "doc_id long, n long, k1 long, k2 long, registers binary")


def verify(pairs: DataFrame, texts: DataFrame, made: DataFrame, k: int, percent: int) -> DataFrame:
    """Of distinct ``pairs`` (a, b) those with 100 * intersection >= percent * union.

    Every pair's two texts meet in a group of its ``a``; an ``a`` with many pairs is dealt to
    several groups.  One join by document brings the texts, whatever the number of pairs."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    members = pairs.join(counts, "a").select(
        F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(1).alias("kind"))
    leaders = counts.select(
        F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    sized = made.select(F.col("doc_id").alias("id"), "n", "registers")
    loaded = leaders.unionAll(members).join(sized, "id").join(texts.withColumnRenamed("doc_id", "id"), "id")
    groups = loaded.select("a", "part", "kind", "id", "n", "registers", "text").repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    least = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for whole in batches:
            for batch in slices(whole, 6):
                sets = shingle_sets(batch.column(6), k)
                registers = [np.frombuffer(x, np.uint16) for x in batch.column(5).to_pylist()]
                found = []
                for i, (a, part, kind, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                    if (a, part) != key:
                        key, heads = (a, part), []
                    if kind == 0:
                        heads.append((sets[i], registers[i]))
                        continue
                    for s, r in heads:
                        n_s, n_b = np.array([len(s)]), np.array([len(sets[i])])
                        if worth_verifying(r[None, :], registers[i][None, :], n_s, n_b, least)[0]:
                            both = len(np.intersect1d(s, sets[i], assume_unique=True))
                            if 100 * both >= percent * (len(s) + len(sets[i]) - both):
                                found.append((a, b))
                                break
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def remaining_links(
    cand: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, rows: int,
) -> DataFrame:
    """Links between different components that share a bucket, leaders left out.

    Every member has a home block of its bucket; members outside the bucket's largest
    component also visit all its blocks.  Blocks are compared inside tasks, a pair only in
    the first band it shares; what joins two components there is verified on full sets, and
    just such links leave the task, so fewer rows than members."""
    rest = cand.where("size > 2 and rep <> leader").select("bucket", "band", "rep").join(
        labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    per = rest.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = per.groupBy("bucket").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "label"))["label"].alias("largest"), F.count("*").alias("labels")).where("labels > 1")
    blocks = F.ceil(F.col("all") / BLOCK).cast("long")
    known = written(rest.join(mixed.select("bucket", "largest", blocks.alias("blocks")), "bucket"), "mixed")
    home = known.select("bucket", "band", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), "rep", "label", F.lit(0).alias("visit"))
    visit = known.where("label <> largest").select(
        "bucket", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "rep", "label", F.lit(1).alias("visit"))
    loaded = home.unionAll(visit).join(reps.select("rep", "n", "registers"), "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    groups = loaded.select("bucket", "block", "visit", "band", "rep", "label", "n", "registers", "text").repartition(
        "bucket", "block").sortWithinPartitions("bucket", "block", "visit")
    least = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, table, root, sets = None, [], None, {}, {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        def set_of(rep: int, text: str) -> np.ndarray:
            if (rep, text) not in sets:
                sets[rep, text] = shingle_sets(pa.array([text]), k)[0]
            return sets[rep, text]

        for whole in batches:
            for batch in slices(whole, 8):
                found: list[tuple[int, int]] = []
                for bucket, block, visiting, band, rep, label, n, registers, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if (bucket, block) != key:
                        key, homes, table, root, sets = (bucket, block), [], None, {}, {}
                    mine = np.frombuffer(registers, np.uint16)
                    if not visiting:
                        homes.append((rep, label, n, mine, text))
                        continue
                    if table is None and homes:
                        table = [np.array(c) for c in list(zip(*homes))[:4]]
                    if table is None:
                        continue
                    ids, labels_of, sizes, held = table
                    at = np.flatnonzero(labels_of != label)
                    at = at[worth_verifying(held[at], mine[None, :], sizes[at], np.array([n]), least)]
                    shared = (held[at] == mine).reshape(len(at), len(mine) // rows, rows).all(axis=2)
                    at = at[shared.argmax(axis=1) == band]
                    for i in at.tolist():
                        other = int(labels_of[i])
                        if find(label) == find(other):
                            continue
                        a, b = set_of(rep, text), set_of(int(ids[i]), homes[i][4])
                        both = len(np.intersect1d(a, b, assume_unique=True))
                        if 100 * both >= percent * (len(a) + len(b) - both):
                            root[find(label)] = find(other)
                            found.append((min(rep, int(ids[i])), max(rep, int(ids[i]))))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 50, rows: int = 7,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept (whether it is that id)."""
    texts = id_text(docs, id_col, text_col)
    made = written(sketches(texts, shingle, bands * rows), "sketches")
    live = made.where("n > 0 and doc_id is not null")
    classes = written(live.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = live.join(classes.withColumnRenamed("rep", "doc_id"), ["k1", "k2", "doc_id"], "left_semi").withColumnRenamed("doc_id", "rep")

    width = 2 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * width + 1, F.lit(width))))
    in_bands = reps.select("rep", F.posexplode(keys).alias("band", "bucket"))
    buckets = in_bands.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).where("size > 1")
    cand = written(in_bands.join(buckets, "bucket"), "buckets")
    firsts = written(cand.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    ids = texts.where("doc_id is not null")
    links = written(verify(firsts, ids, live, shingle, percent), "verified")
    labels = components(links)
    late = written(remaining_links(cand, labels, reps, ids, shingle, percent, rows), "verified")
    if not late.isEmpty():
        labels = components(links.unionAll(late))
    smallest = labels.groupBy("label").agg(F.min("node").alias("component_id"))
    of_rep = labels.join(smallest, "label").select(F.col("node").alias("rep"), "component_id")
    known = live.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2"]).join(of_rep, "rep", "left").select(
        "doc_id", "n", F.coalesce("component_id", "rep").alias("component_id"))
    rest = made.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return known.unionAll(rest).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
