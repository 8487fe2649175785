"""Substring deduplication with prefix-partitioned suffix trees.

A window is ``width`` consecutive words.  A window is a repeat if the same words also start
in a document with a smaller id; every word a repeat covers is removed.

1. *Prefixes.*  Every window holds a smallest ``gram``-word run by hash (its minimizer), and
   equal windows hold it at the same place.  Windows of a document that share it are
   consecutive, so a text is cut into about one run of windows per 20 words; the run's first
   words up to the end of the gram, 10 to 50 of them, are its variable-length prefix.
   Only grams found in two documents or more go on.
2. *Groups.*  The runs of one gram, with their words, make a group of suffixes; small groups
   are handled together, a group of more than ``block_rows`` runs is dealt to several blocks.
3. *Subtrees.*  In a block the suffixes are named by prefixes of 1, 2, 4, ... words by
   doubling (Karp, Miller, Rosenberg 1972), which gives the nodes of their suffix tree at
   these depths without pointers; the nodes at depth ``width`` with two documents or more
   are the repeats.  The smallest document of each node keeps its words.
4. Where a group was dealt to several blocks, the windows that are smallest in their block
   meet once more by the hash of their words in an aggregate with map-side combine.

Memory per task is one block; no key is collected, and a passage that a third of all
documents share is spread over blocks, which first shrink it to one window each.

Edge cases: a null or empty text has no words; a null id is neither smaller nor larger than
any other, so its words stay; rows that repeat an id are one document in two parts, neither
smaller than the other; texts shorter than a window stay whole; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.base import id_text, map_batches, slices, written
from modlens.llm.words import hash_words, joined, window_hashes, word_codes

RUNS = "gram long, doc_id long, row int, start long, n long"
FLAGS = "doc_id long, row int, start long, n long, gram long, window long"


def first_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest entry of each run of ``width`` entries."""
    index, size = np.arange(len(v)), 1

    def join(step: int) -> None:
        nonlocal v, index
        right = v[step:] < v[:-step]
        v, index = np.where(right, v[step:], v[:-step]), np.where(right, index[step:], index[:-step])

    while size * 2 <= width:
        join(size)
        size *= 2
    if size < width:
        join(width - size)
    return index


def runs_of(h: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: gram hash, text, start in the text, number of windows."""
    empty = (np.zeros(0, np.int64),) * 4
    if len(h) < width:
        return empty
    grams = window_hashes(h, gram)
    at = first_minimum(grams, width - gram + 1)                  # by window start
    size = np.diff(offsets)
    windows = np.maximum(size - width + 1, 0)
    text = np.repeat(np.arange(len(size)), windows)
    if not len(text):
        return empty
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    anchor = at[offsets[text] + start]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    n = np.diff(np.r_[first, len(text)])
    return grams[anchor[first]].view(np.int64), text[first], start[first], n


def find_runs(texts: DataFrame, width: int, gram: int) -> DataFrame:
    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 1):
            codes, offsets, values = word_codes(part.column(1))
            g, text, start, n = runs_of(hash_words(values)[codes], offsets, width, gram)
            if len(g):
                where = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), part.column(0).take(where), part.column(2).take(where), pa.array(start), pa.array(n)],
                    names=["gram", "doc_id", "row", "start", "n"])

    return map_batches(texts.where("doc_id is not null").select("doc_id", "text", "row"), one, RUNS)


def with_words(texts: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """Each run with the words of its windows."""
    per = runs.groupBy("doc_id", "row").agg(F.collect_list(F.struct("gram", "start", "n", "block")).alias("runs"))
    both = texts.join(per, ["doc_id", "row"]).select("doc_id", "row", "text", "runs")

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 2):
            lists = part.column(3)
            which = pc.list_parent_indices(lists)
            flat = pc.list_flatten(lists)
            gram, start, n, block = (flat.field(i) for i in range(4))
            codes, offsets, values = word_codes(part.column(2))
            first = offsets[which.to_numpy(zero_copy_only=False)] + start.to_numpy()
            size = n.to_numpy() + width - 1
            take = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            yield pa.RecordBatch.from_arrays(
                [gram, block, part.column(0).take(which), part.column(1).take(which), start, n,
                 joined(values, codes[take], np.r_[0, np.cumsum(size)])],
                names=["gram", "block", "doc_id", "row", "start", "n", "words"])

    return map_batches(both, one, "gram long, block long, doc_id long, row int, start long, n long, words string")


def name_windows(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Names of the ``width`` words from each start: equal exactly where the words are."""
    def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]

    names, size = codes, 1
    while size * 2 <= width:
        names = named(names[:-size], names[size:])
        size *= 2
    return named(names[starts], names[starts + width - size])


def judge_block(rows: pa.Table, width: int) -> pa.RecordBatch:
    """Flagged runs of windows of a block, and the open windows of groups in several blocks."""
    codes, offsets, values = word_codes(rows.column("words").combine_chunks())
    doc, row, start, n, gram, parts = (rows.column(c).to_numpy() for c in ("doc_id", "row", "start", "n", "gram", "blocks"))
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[of] + step
    name = name_windows(codes, at, width)
    least = np.full(int(name.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, name, doc[of])
    repeat = doc[of] > least[name]
    begins = np.flatnonzero(repeat & np.r_[True, ~repeat[:-1] | (of[1:] != of[:-1])])
    ends = np.flatnonzero(repeat & np.r_[~repeat[1:] | (of[1:] != of[:-1]), True])
    open_ = np.flatnonzero(~repeat & (parts[of] > 1))
    windows = window_hashes(hash_words(values)[codes], width, salt=width)[at[open_]].view(np.int64)
    a, b = of[begins], of[open_]
    none = pa.nulls(len(a), pa.int64())
    both = lambda x, y: pa.chunked_array([pa.array(x, pa.int64()), pa.array(y, pa.int64())]).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [both(doc[a], doc[b]), both(row[a], row[b]).cast(pa.int32()), both(start[a] + step[begins], start[b] + step[open_]),
         both(ends - begins + 1, np.ones(len(b), np.int64)), both(gram[a], gram[b]),
         pa.chunked_array([none, pa.array(windows, pa.int64())]).combine_chunks()],
        names=[c.split()[0] for c in FLAGS.split(", ")])


def judge(runs: DataFrame, width: int, block_rows: int) -> DataFrame:
    """Blocks of whole (gram, block) groups, each of about ``block_rows`` runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                if size < block_rows:                       # take up to there, then to the end of the group
                    cut = min(block_rows - size, batch.num_rows)
                    held.append(batch.slice(0, cut))
                    size += cut
                    batch = batch.slice(cut)
                    continue
                last = held[-1].slice(held[-1].num_rows - 1)
                keys = [batch.column(i).to_numpy() != last.column(i)[0].as_py() for i in (0, 1)]
                other = np.flatnonzero(keys[0] | keys[1])
                cut = int(other[0]) if len(other) else batch.num_rows
                if cut:
                    held.append(batch.slice(0, cut))
                    size += cut
                batch = batch.slice(cut)
                if len(other):
                    yield judge_block(pa.Table.from_batches(held), width)
                    held, size = [], 0
        if held:
            yield judge_block(pa.Table.from_batches(held), width)

    grouped = runs.repartition("gram", "block").sortWithinPartitions("gram", "block")
    return grouped.select("gram", "block", "doc_id", "row", "start", "n", "words", "blocks").mapInArrow(run, FLAGS)


def repeats(texts: DataFrame, width: int, gram: int, block_rows: int) -> DataFrame:
    """doc_id, row, start, n: runs of windows that a document with a smaller id holds too."""
    runs = find_runs(texts, width, gram)             # found twice: cheaper than to keep them
    shared = runs.groupBy("gram").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("rows")).where("least < most")
    blocks = F.ceil(F.col("rows") / block_rows).cast("long")
    # written, so that the join's inputs are plain exchanges and a frequent gram can be split
    shared = written(shared.select("gram", blocks.alias("blocks")), "grams")
    dealt = runs.join(shared, "gram").withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "row", "start"), "blocks") * 65536 + F.least("blocks", F.lit(65535)))
    with_text = with_words(texts, dealt, width).withColumn("blocks", F.col("block") % 65536)
    flags = written(judge(with_text, width, block_rows), "flags")
    waiting = flags.where("window is not null")
    least = waiting.groupBy("gram", "window").agg(F.min("doc_id").alias("least"))
    late = waiting.join(least, ["gram", "window"]).where("doc_id > least")
    cols = ["doc_id", "row", "start", "n"]
    return flags.where("window is null").select(*cols).unionByName(late.select(*cols))


def remove_repeats(
    docs: DataFrame, width: int = 50, gram: int = 10, block_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: its words, how many were removed, and the kept text (words joined by one space)."""
    texts = id_text(docs, id_col, text_col).withColumn("row", F.hash("text"))   # 32 bits tell texts of one id apart
    per = repeats(texts, width, gram, block_rows).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    both = texts.join(per, ["doc_id", "row"], "left").select("doc_id", "text", "runs")

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 1):
            codes, offsets, values = word_codes(part.column(1))
            lists = part.column(2)
            which = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(lists)
            change = np.zeros(len(codes) + 1, np.int64)
            if len(which):
                start, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                first = offsets[which] + start
                np.add.at(change, first, 1)
                np.add.at(change, first + n + width - 1, -1)
            keep = np.cumsum(change)[:-1] == 0
            kept_at = np.r_[0, np.cumsum(keep)][offsets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(offsets) - np.diff(kept_at)),
                 joined(values, codes[keep], kept_at)],
                names=["doc_id", "n_words", "n_removed", "kept"])

    return map_batches(both, one, "doc_id long, n_words long, n_removed long, kept string")
