"""Near duplicates by SimHash, found through segment popcounts.

*Fingerprint.*  A text's words (A-Z lower-cased) form shingles, repeats included; a bit of the
64 is set if more than half of the shingles' XXH64 (seed 42) have it.  Texts whose fingerprints
differ in ``most`` = 3 bits or fewer are linked.

*Embedding.*  Each of the 32 segments of two bits becomes its number of set bits, so a
fingerprint is a point of {0, 1, 2}^32.  One flipped bit moves it by one step, hence the Manhattan
distance of points is at most the Hamming distance of fingerprints.

*Grid range-join.*  Two points within 3 are within 1 on one half of the axes.  The grid's cells
are the 16 coordinates of a half.  Every fingerprint is at home in its cell of either half; those
of even coordinate sum also probe the cells one step away (their sums are odd, so only one of two
neighbours probes).  Pairs that meet are held against the Manhattan bound over all axes, then
exactly by the bits that differ.

*Linking without all pairs.*
1. Equal fingerprints are one node, with the smallest id.
2. Fingerprints that differ only inside one segment of four bits meet under the other 60; such
   a group has 16 members at most.  Links inside them join what a cluster of copies has of
   close fingerprints.
3. Only cells that still hold several components are compared.  Their members are dealt to
   blocks of about ``block``; those outside the cell's largest component visit each of its
   blocks.  What leaves a task are pairs of components, each once a batch.
So a large group of copies is one node, a cluster of near copies is one component before cells are
compared, and no cell is capped or held as a whole.

Edge cases: a null or empty text, or one without words, has the fingerprint zero and is linked
like any other; a null id takes part and is never the smallest (a component of null ids has a
null component); rows that repeat an id are texts of their own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.llm.base import id_text, map_batches, slices, written
from modlens.llm.components import components
from modlens.llm.words import word_codes

SEED, AXES = 42, 16
PAIRS = 1 << 21
#: bit k of a byte as one in byte k of a 64-bit number
SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)
LOW = 0x5555555555555555


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint per text from the hashes of all its shingles, ``sizes`` of them each."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    size = sizes[some]
    first = np.cumsum(size) - size
    parts = -(-size // 255)                              # a byte lane counts up to 255
    of = np.repeat(np.arange(len(size)), parts)
    step = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    raw = h.view(np.uint8).reshape(-1, 8)
    bits = np.empty((len(size), 64), bool)
    for b in range(8):
        lanes = np.add.reduceat(SPREAD[raw[:, b]], first[of] + 255 * step)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), np.cumsum(parts) - parts, axis=0)
        bits[:, 8 * b:8 * b + 8] = 2 * counts > size[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of all texts, and their number in each; fewer than k words are one shingle."""
    import xxhash

    codes, offsets, values = word_codes(texts, lower=True)
    size = np.diff(offsets)
    number = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(len(size)), number)
    at = offsets[text] + np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    words = values.take(pa.array(codes))
    joined = words.take(pa.array(at))
    for step in range(1, k):
        inside = at + step < offsets[text + 1]
        following = words.take(pa.array(np.where(inside, at + step, 0), mask=~inside)) if len(words) else words
        joined = pc.binary_join_element_wise(joined, following, pa.scalar(" ", joined.type), null_handling="skip")
    h = xxhash.xxh64_intdigest
    found = joined.to_numpy(zero_copy_only=False).tolist()
    return np.fromiter((h(s, SEED) for s in found), np.uint64, len(found)), number


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 1):
            fp = majority(*shingle_hashes(part.column(1), k))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(id_text(docs, id_col, text_col), one, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The 32 counts of two bits each, packed like the fingerprint."""
    one, other = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return one.bitwiseXOR(other).bitwiseOR(F.shiftleft(one.bitwiseAND(other), 1))


def distance(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def close_links(nodes: DataFrame, most: int) -> DataFrame:
    """Links (a, b) between fingerprints that differ inside one segment of four bits only."""
    masked = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i")).select(
        "fp", "i", F.col("fp").bitwiseAND(F.bitwise_not(F.expr("shiftleft(15L, 4 * i)"))).alias("rest"))
    sets = masked.groupBy("i", "rest").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)   # 16 at most
    near = lambda x: F.filter("fps", lambda y: (y != x) & (distance(x, y) <= most))
    links = sets.select(F.explode(F.transform("fps", lambda x: F.struct(x.alias("a"), F.get(near(x), F.lit(0)).alias("b")))).alias("l"))
    return links.select("l.a", "l.b").where("b is not null")


def cells(nodes: DataFrame) -> DataFrame:
    """side, cell, fp, label, probe: every fingerprint at home in its two cells, and the cells next to it that it probes."""
    packed = popcounts(F.col("fp"))
    sides = F.array(packed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(packed, 32))
    halves = nodes.select("fp", "label", F.posexplode(sides).alias("side", "home"))
    half_bits = F.when(F.col("side") == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    axis = F.sequence(F.lit(0), F.lit(AXES - 1))

    def moved(up: bool) -> Column:
        step = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), 2 * i)
        count = lambda i: F.call_function("shiftrightunsigned", F.col("home"), 2 * i).bitwiseAND(F.lit(3))
        free = F.filter(axis, (lambda i: count(i) < 2) if up else (lambda i: count(i) > 0))
        return F.transform(free, (lambda i: F.col("home") + step(i)) if up else (lambda i: F.col("home") - step(i)))

    even = F.bit_count(half_bits) % 2 == 0
    probed = F.when(even, F.concat(F.array("home"), moved(True), moved(False))).otherwise(F.array("home"))
    return halves.select("side", "fp", "label", "home", F.explode(probed).alias("cell")).select(
        "side", "cell", "fp", "label", (F.col("cell") != F.col("home")).alias("probe"))


def links_in(rows: DataFrame, most: int) -> DataFrame:
    """Pairs of components that two members of one block's rows link."""

    def counts(x: np.ndarray) -> np.ndarray:
        low = np.uint64(LOW)
        a, b = x & low, (x >> np.uint64(1)) & low
        return (a ^ b) | ((a & b) << np.uint64(1))

    def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Over packed counts: of the larger less the smaller in each segment, the sum."""
        out = np.zeros(len(x), np.int64)
        for s in range(0, 64, 2):
            p, q = (x >> np.uint64(s)) & np.uint64(3), (y >> np.uint64(s)) & np.uint64(3)
            out += np.abs(p.astype(np.int8) - q.astype(np.int8))
        return out

    def matched(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        side, cell, block, fp, label, probe, visit = (t.column(c).to_numpy(zero_copy_only=False) for c in range(7))
        fp = fp.view(np.uint64)
        new = np.r_[True, (side[1:] != side[:-1]) | (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])]
        group = np.cumsum(new) - 1
        begin, residents = np.flatnonzero(new), np.bincount(group, visit == 0).astype(np.int64)
        visitors = np.flatnonzero(visit == 1)
        done, total = 0, np.cumsum(residents[group[visitors]])
        pairs = []
        while done < len(visitors):
            seen = total[done - 1] if done else 0
            end = max(done + 1, int(np.searchsorted(total, seen + PAIRS, side="right")))
            v = visitors[done:end]
            n = residents[group[v]]
            x = np.repeat(v, n)
            y = begin[group[x]] + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            on = (label[x] != label[y]) & ~(probe[x] & probe[y])
            x, y = x[on], y[on]
            on = manhattan(counts(fp[x]), counts(fp[y])) <= most
            x, y = x[on], y[on]
            on = np.bitwise_count(fp[x] ^ fp[y]) <= most
            pairs.append(np.stack([np.minimum(label[x[on]], label[y[on]]), np.maximum(label[x[on]], label[y[on]])]))
            done = end
        found = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
        if found.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                       # residents of the last group so far
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            yield from matched(batch)
            key = [batch.column(c).to_numpy() for c in range(3)]
            last = (key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])
            held = batch.take(pa.array(np.flatnonzero(last & (batch.column(6).to_numpy() == 0))))

    dealt = rows.select("side", "cell", "block", "fp", "label", "probe", "visit").repartition("side", "cell", "block")
    return dealt.sortWithinPartitions("side", "cell", "block", "visit").mapInArrow(run, "a long, b long")


def remaining_links(nodes: DataFrame, most: int, block: int) -> DataFrame:
    """Links between different components by the range-join."""
    rows = cells(nodes)
    per = rows.groupBy("side", "cell", "label").agg(F.count("*").alias("n"), F.min("probe").alias("only_probes"))
    mixed = per.groupBy("side", "cell").agg(
        F.sum("n").alias("all"), F.count("*").alias("labels"), F.min("only_probes").alias("no_home"),
        F.max(F.struct("n", "label"))["label"].alias("largest")).where("labels > 1 and not no_home")
    mixed = written(mixed.select("side", "cell", "largest", F.ceil(F.col("all") / block).cast("int").alias("blocks")), "cells")
    known = rows.join(mixed, ["side", "cell"])
    visits = F.when(F.col("label") != F.col("largest"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array().cast("array<int>"))
    home = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    places = F.concat(F.array(F.struct(home.alias("block"), F.lit(0).alias("visit"))),
                      F.transform(visits, lambda b: F.struct(b.alias("block"), F.lit(1).alias("visit"))))
    dealt = known.select("side", "cell", "fp", "label", "probe", F.explode(places).alias("p"))
    return links_in(dealt.select("side", "cell", "p.block", "fp", "label", "probe", "p.visit"), most)


def near_duplicates(
    docs: DataFrame, shingle: int = 3, most: int = 3, block: int = 256, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable."""
    if not 0 <= most <= 3:
        raise ValueError("the grid finds fingerprints that differ in three bits at most")
    made = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = written(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    close = components(close_links(nodes, most))
    labelled = written(nodes.join(close, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")), "labels")
    wide = components(remaining_links(labelled.select("fp", "label"), most, block)).select(
        F.col("node").alias("label"), F.col("label").alias("wide"))
    joined = labelled.join(wide, "label", "left").select("fp", "least", F.coalesce("wide", "label").alias("label"))
    joined = written(joined, "labels")
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    of = written(joined.join(least, "label").select("fp", "component_id"), "components")
    return made.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
