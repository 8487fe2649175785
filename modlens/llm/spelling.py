"""Spelling variants of a corpus' words by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one into the other,
that is, if their common prefix and common suffix together reach the longer length minus one.

*Keys.*  Let M be the longer length.  The edit stands at some place e below M; before it the
words share e code points, behind it M - 1 - e.  So for any interval [lo, hi) that holds e they
share the first lo and the last M - hi code points.  A word of length L enters the groups of M = L
and M = L + 1, with one key per interval (``pieces`` of them at first).  A pair counts only in
the interval that holds its common prefix, so it is found once.

*Tiles.*  A group is one tile: its words as rows of a matrix of code points, padded behind
(for prefixes) and in front (for suffixes), rows compared with the rows d below them for all d.
A group of more than ``block`` words is not compared: its words go on with the interval halved.
At width one a group holds words that differ at one known place, no more than the alphabet
has letters.  So every pair is compared, no tile exceeds its size, and no group is held or
counted anywhere; one shuffle a level, of words only.

*Forms.*  The form of a word is its near word with the largest count, if that is ``factor`` times
its own or more.  Counts grow by the factor at each step, so roots are found by doubling
pointers in a number of rounds that follows from the largest count.

Counts are added up per task, then by an aggregate with map-side combine, so a word that
makes up a third of the corpus is one row per task.

Edge cases: a null or empty text has no words; a null id counts as the empty id in the
planted deletions; rows that repeat an id or a text count each; ties of counts go to the smallest form
in code-point order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.base import id_text, map_batches, slices, written
from modlens.llm.words import word_codes

#: everything between runs of letters; all letters are below U+0100, so a code point is one Latin-1 byte
NOT_LETTERS = "[^A-Za-zÀ-ÿ]+"
FOUND = "word string, n long, other string, other_n long, m int, lo int, hi int"
#: cells of a matrix compared at once
CELLS = 1 << 24


def count_words(docs: DataFrame, min_length: int, planted: int | None, id_col: str, text_col: str) -> DataFrame:
    """word, n: the lower-cased runs of letters of ``min_length`` or more.

    ``planted`` deletes a letter of those runs whose checksum with the id it divides, at the
    checksum's place, which gives a corpus with known misspellings."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 1):
            codes, offsets, values = word_codes(pc.replace_substring_regex(part.column(1), NOT_LETTERS, " "), lower=True)
            size = pc.utf8_length(values).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            long = size[codes] >= min_length
            codes, text = codes[long], text[long]
            found = Counter()
            if planted:
                pair, n = np.unique(text * max(len(values), 1) + codes, return_counts=True)
                of, word = np.divmod(pair, max(len(values), 1))
                start = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in part.column(0).to_pylist()]
                raw, crc = [v.encode() for v in values.to_pylist()], zlib.crc32
                check = np.array([crc(raw[w], start[t]) for t, w in zip(of.tolist(), word.tolist())], np.int64)
                hit = check % planted == 0
                for h, w, k in zip(check[hit].tolist(), word[hit].tolist(), n[hit].tolist()):
                    whole = raw[w].decode()
                    at = h % len(whole)
                    if len(whole) > min_length:
                        found[whole[:at] + whole[at + 1:]] += k
                total = np.bincount(word[~hit], n[~hit], minlength=len(values)).astype(np.int64)
            else:
                total = np.bincount(codes, minlength=len(values))
            some = np.flatnonzero(total)
            words = pa.concat_arrays([values.take(pa.array(some)).cast(pa.string()), pa.array(list(found), pa.string())])
            yield pa.RecordBatch.from_arrays(
                [words, pa.array(np.r_[total[some], np.array(list(found.values()), np.int64)])], names=["word", "n"])

    return map_batches(id_text(docs, id_col, text_col), one, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def with_keys(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, lo, hi) with the key of their group."""
    rest = F.col("m") - F.col("hi")
    size = F.length("word")
    shared = F.xxhash64("m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", size - rest + 1, rest))
    return rows.select("m", "lo", "hi", shared.alias("key"), "word", "n")


def first_keys(words: DataFrame, pieces: int) -> DataFrame:
    size = F.length("word")
    cut = lambda i: F.floor(i * F.col("m") / pieces).cast("int")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m")).select(
        "word", "n", "m", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("i"))
    return with_keys(rows.select("word", "n", "m", cut(F.col("i")).alias("lo"), cut(F.col("i") + 1).alias("hi")).where("lo < hi"))


def halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    two = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return with_keys(rows.select("word", "n", "m", F.explode(two).alias("part")).select("word", "n", "m", "part.lo", "part.hi"))


def matrices(words: list[bytes], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and the words as rows of ``m`` code points: padded behind, and padded in front and reversed."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat, column = np.frombuffer(b"".join(words), np.uint8), np.arange(m)
    front, back = np.zeros((len(words), m), np.uint8), np.zeros((len(words), m), np.uint8)
    front[column < size[:, None]] = flat
    back[column >= m - size[:, None]] = flat
    return size, front, back[:, ::-1]


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of each two rows, which are not equal."""
    return np.argmax(a != b, axis=1)


def tile(words: list[bytes], group: np.ndarray, lo: np.ndarray, hi: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of near words in one group whose common prefix lies in the group's interval.

    ``group`` numbers the rows' groups in ascending order."""
    size, front, back = matrices(words, m)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, d = np.arange(len(words)), 1
    while True:
        at = at[at + d < len(words)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            return np.concatenate(left), np.concatenate(right)
        a = at[np.maximum(size[at], size[at + d]) == m]               # else the pair belongs to a smaller m
        prefix = common(front[a], front[a + d])
        near = (prefix >= lo[a]) & (prefix < hi[a])
        a, prefix = a[near], prefix[near]
        a = a[prefix + common(back[a], back[a + d]) >= m - 1]
        left.append(a)
        right.append(a + d)
        d += 1


def compare(rows: DataFrame, block: int) -> DataFrame:
    """Near pairs of all groups; words of groups beyond ``block`` come back with null ``other``."""

    def out(words, n, others, other_n, m, lo, hi) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [words, pa.array(n), others, other_n, pa.array(m, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
            names=[c.split()[0] for c in FOUND.split(", ")])

    def too_large(t: pa.RecordBatch, where: np.ndarray) -> pa.RecordBatch:
        t = t.take(pa.array(where))
        m, lo, hi, n = (t.column(c).to_numpy() for c in ("m", "lo", "hi", "n"))
        return out(t.column("word"), n, pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.int64()), m, lo, hi)

    def groups(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Whole groups, in order."""
        m, lo, hi, n, key = (t.column(c).to_numpy() for c in ("m", "lo", "hi", "n", "key"))
        new = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (m[1:] != m[:-1])]
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group]
        over = (size > block) & (hi - lo > 1)
        if over.any():
            yield too_large(t, np.flatnonzero(over))
        use = np.flatnonzero((size > 1) & ~over)
        while len(use):                                              # rows of one m, whole groups, within the size of a matrix
            width = int(m[use[0]])
            most = max(1, CELLS // width)
            stop = int(np.argmax(np.r_[m[use] != width, True]))
            if stop > most:
                last = group[use[most]]
                stop = int(np.searchsorted(group[use], last)) or int(np.searchsorted(group[use], last, side="right"))
            part, use = use[:stop], use[stop:]
            words = [w.encode("latin-1") for w in t.column("word").take(pa.array(part)).to_pylist()]
            i, j = tile(words, group[part], lo[part], hi[part], width)
            if len(i):
                a, b = pa.array(part[i]), pa.array(part[j])
                w = t.column("word")
                yield out(w.take(a), n[part[i]], w.take(b), pa.array(n[part[j]]), m[part[i]], lo[part[i]], hi[part[i]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []                              # the last group so far
        count, over = 0, None                                        # its rows; its key once it is known to be too large
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("m", "lo", "key")])
            if over is not None:
                same = int(np.argmin(np.r_[(key == over[:, None]).all(axis=0), False]))
                if same:
                    yield too_large(batch, np.arange(same))
                batch, key = batch.slice(same), key[:, same:]
                if not batch.num_rows:
                    continue
                over = None
            last = int(np.argmax(np.r_[(key == key[:, -1:]).all(axis=0)]))  # keys are sorted: the last group starts here
            if held:
                first = pa.Table.from_batches([held[0].slice(0, 1)])
                before = np.array([first.column(c)[0].as_py() for c in ("m", "lo", "key")])
                if last == 0 and (key[:, 0] == before).all():
                    held.append(batch)
                else:
                    yield from groups(_one([*held, batch.slice(0, last)]))
                    held = [batch.slice(last)]
            else:
                if last:
                    yield from groups(batch.slice(0, last))
                held = [batch.slice(last)]
            count = sum(b.num_rows for b in held)
            width = held[0].column("hi")[0].as_py() - held[0].column("lo")[0].as_py()
            if count > block and width > 1:
                for b in held:
                    yield too_large(b, np.arange(b.num_rows))
                over, held = key[:, -1], []
        if held:
            yield from groups(_one(held))

    dealt = rows.repartition("m", "lo", "key").sortWithinPartitions("m", "lo", "key")
    return dealt.mapInArrow(run, FOUND)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def near_words(words: DataFrame, pieces: int = 4, block: int = 256) -> DataFrame:
    """word, n, other, other_n: every near pair once.  A level that leaves no large group is the last."""
    found, rows = None, first_keys(words, pieces)
    while True:
        level = written(compare(rows, block), "spelling")
        pairs = level.where("other is not null").select("word", "n", "other", "other_n")
        found = pairs if found is None else found.unionAll(pairs)
        large = level.where("other is null")
        if large.isEmpty():
            return found
        rows = halved(large)


def roots(forms: DataFrame, most: int, factor: int) -> DataFrame:
    """word, root: the end of each chain of forms; ``most`` is the largest count."""
    hops = max(1, math.ceil(math.log(max(most, 1), factor)))
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(hops + 1))):
        there = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = written(out.join(there, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return out


def group_variants(
    docs: DataFrame, min_length: int = 7, min_count: int = 2, factor: int = 10, pieces: int = 4, block: int = 256,
    planted: int | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """word, n, form, form_n, root and n_near of every word of ``min_length`` letters found ``min_count`` times."""
    counts = count_words(docs, min_length, planted, id_col, text_col)
    words = written(counts.where(F.col("n") >= min_count), "words")
    pairs = near_words(words, pieces, block)
    both = pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = both.groupBy("word").agg(F.max("n").alias("own"), F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus") >= factor * F.col("own")
    near = written(near.select(
        "word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "near")
    most = near.agg(F.max("form_n")).first()[0]
    ends = roots(near.where("form is not null"), most or 1, factor)
    return words.join(near, "word", "left").join(ends, "word", "left").select(
        "word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
