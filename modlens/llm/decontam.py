"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with up to k = m * budget edits.  Cut into k + 1 pieces,
at least one piece must occur unchanged (pigeonhole).  An automaton over all pieces finds
them in one pass over a text; each hit gives a window in which Myers' bit-parallel
algorithm (J. ACM 46(3), 1999) finds the smallest edit distance of the item to any
substring.  Hits of an item that lie close together share one window.  No match within the
budget is lost, and none beyond it is reported.

Texts and items are compared in lower case with runs of white space as one space.

The items are a query set that does not grow with the documents.  They come in blocks of at
most ``block_chars`` characters; each block, whatever the benchmark's size, is shipped to
the tasks and run against all documents.  There is no shuffle.

Edge cases: a null or empty text matches nothing; items that are null or shorter than
``min_chars`` match nothing, as a few words occur by chance; equal items are reported each
under its own id; a null id is kept; repeated rows are searched each for itself; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.llm.base import id_text, map_batches

SCHEMA = "doc_id long, item_id long, distance long, max_distance long, start long, end long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def masks(pattern: str) -> dict[str, int]:
    """For each character, the bits of the positions where the pattern has it."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a substring of ``text`` and the first position
    after such a substring (``anchored``: to a prefix of ``text``)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 | anchored
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, at = score, j + 1
    return best, at


class Items:
    """The automaton over the pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        import ahocorasick

        self.items = items
        self.bits: dict[int, tuple[dict, dict]] = {}
        self.budget = [int(len(t) * budget) for _, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(items):
            parts = self.budget[n] + 1
            cuts = [len(text) * p // parts for p in range(parts + 1)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                pieces.setdefault(text[a:b], []).append((n, b))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best match of each item in a normal text."""
        windows: dict[int, list[list[int]]] = {}
        for end, where in self.automaton.iter(text):
            for n, piece_end in where:
                k, m = self.budget[n], len(self.items[n][1])
                a = end + 1 - piece_end - k
                b = a + m + 2 * k
                of = windows.setdefault(n, [])
                if of and a <= of[-1][1] and a >= of[-1][0]:
                    of[-1][1] = max(of[-1][1], b)
                else:
                    of.append([a, b])
        out = []
        for n, spans in windows.items():
            pattern = self.items[n][1]
            m = len(pattern)
            if n not in self.bits:
                self.bits[n] = masks(pattern), masks(pattern[::-1])
            best = None
            for a, b in spans:
                a, b = max(a, 0), min(b, len(text))
                if b - a < m - self.budget[n]:
                    continue
                distance, at = best_end(self.bits[n][0], m, text[a:b])
                if distance <= self.budget[n] and (best is None or distance < best[0]):
                    best = distance, a + at
            if best:
                distance, end = best
                head = text[max(0, end - m - distance):end][::-1]
                out.append((n, distance, end - best_end(self.bits[n][1], m, head, anchored=True)[1], end))
        return out


def _original(text: str, start: int, end: int) -> tuple[int, int]:
    """Where characters ``start`` to ``end`` of the normal text stand in the text itself."""
    at, first, last = 0, 0, 0
    for m in re.finditer(r"\S+", text):
        size = len(m[0].lower())
        if at <= start <= at + size:
            first = m.start() + min(start - at, len(m[0]))
        if at < end <= at + size:
            last = m.start() + min(end - at, len(m[0]))
            break
        at += size + 1
    return first, max(first, last)


class Shipped:
    """One block of items, at most ``block_chars`` characters, broadcast to the tasks."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, str]], budget: float):
        self.items, self.budget, self.made = spark.sparkContext.broadcast(items), budget, None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def get(self) -> Items:
        if self.made is None:
            self.made = Items(self.items.value, self.budget)
        return self.made


def _match_block(docs: DataFrame, block: Shipped) -> DataFrame:
    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = block.get()
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for n, distance, start, end in found.find(normal(text)):
                rows.append((doc_id, found.items[n][0], distance, found.budget[n], *_original(text, start, end)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)],
            names=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_batches(docs, one, SCHEMA)


def _blocks(
    benchmark: DataFrame, budget: float, min_chars: int, block_chars: int, item_col: str, item_text_col: str,
) -> list[Shipped]:
    spark, blocks, block, size = benchmark.sparkSession, [], [], 0
    wanted = benchmark.select(
        F.col(f"`{item_col}`").cast("long"), F.col(f"`{item_text_col}`").cast("string")).toLocalIterator()
    for item_id, text in wanted:
        text = normal(text or "")
        if len(text) < min_chars:
            continue
        if block and size + len(text) > block_chars:
            blocks.append(Shipped(spark, block, budget))
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    return [*blocks, Shipped(spark, block, budget)] if block else blocks


def match_items(
    docs: DataFrame, benchmark: DataFrame, budget: float = 0.06, min_chars: int = 30, block_chars: int = 8 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item that occurs in it within ``budget`` edits a character:
    the smallest distance, the largest allowed, and where it stands (code points)."""
    texts = id_text(docs, id_col, text_col)
    found = [_match_block(texts, b) for b in _blocks(benchmark, budget, min_chars, block_chars, item_col, item_text_col)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, budget: float = 0.06, min_chars: int = 30, block_chars: int = 8 << 20,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no item; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def without(rows: DataFrame, block: Shipped) -> DataFrame:
        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = block.get()
            yield batch.filter(pa.array([not found.find(normal(t or "")) for t in batch.column(at).to_pylist()], pa.bool_()))

        return map_batches(rows, one, docs.schema)

    return reduce(without, _blocks(benchmark, budget, min_chars, block_chars, item_col, item_text_col), docs)
