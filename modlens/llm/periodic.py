"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q, at least ``min_periods`` of them and
``min_words`` words long, that no neighbour extends.  All but a run's first q words are dropped.

*Where to look.*  In a run every word behind the first q occurred at most q words before.  For
each power of two T, stretches of words whose last occurrence is at most T back, and that
are long enough for a run of period above T/2, are marked, with T words before them.  Every
run lies in a marked piece and is maximal there.  Plain text has next to none, so this
leaves the planted and pathological part; no run is missed.

*Automaton.*  Each piece gets its suffix automaton, whose suffix links form a tree.  Appending
word i is an access of the i-th prefix's state, as in link-cut trees: the path from it to the root
takes the colour i, the place where its strings last ended.  Before that, the path falls into
segments of earlier colours j; the deepest state of a segment holds the longest string that
ends both at i and at j.  If the distance i - j does not exceed it, the two are squares of that
period and reach back over length plus distance words; no smaller period fits, for then a later
colour would hold the string.  Seen at each i up to its last word, a run keeps its start.
The preferred paths are laid along heavy paths, each with a stack of coloured segments, so an access
costs the logarithm of the piece plus the segments that vanish.

Plan: one pass, no shuffle; a task holds some megabytes of text, and the automaton of one piece.

Edge cases: a null or empty text has no words and no runs; a null id is kept; repeated rows are
treated each for itself; a text that is one run keeps its first period; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.base import id_text, map_batches, slices
from modlens.llm.words import joined, word_codes

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string"
SPLIT = r"[\x20\x09-\x0D]+"


def last_distance(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words back each word last occurred in its text; 0 for its first time."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = text * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    back = np.zeros(len(codes), np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    return back


def pieces(codes: np.ndarray, offsets: np.ndarray, min_words: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the stretches that may hold runs."""
    back = last_distance(codes, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    longest, reach = int(np.diff(offsets).max(initial=0)), 1
    change = np.zeros(len(codes) + 1, np.int64)
    while (need := max(min_words - reach, (min_periods - 1) * (reach // 2 + 1), 1)) < longest:
        near = np.r_[0, (back > 0) & (back <= reach), 0].astype(np.int8)   # never at a text's first word
        step = np.diff(near)
        first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        enough = end - first >= need
        first, end = first[enough], end[enough]
        if len(first):
            np.add.at(change, np.maximum(first - reach, offsets[text[first]]), 1)
            np.add.at(change, end, -1)
        reach *= 2
    marked = np.cumsum(change[:-1]) > 0
    if not marked.any():
        return []
    new = np.r_[True, text[1:] != text[:-1]]
    first = np.flatnonzero(marked & (new | ~np.r_[False, marked[:-1]]))
    end = np.flatnonzero(marked & np.r_[new[1:] | ~marked[1:], True]) + 1
    return list(zip(text[first].tolist(), first.tolist(), end.tolist()))


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest length and suffix link of each state (0 is the root), and the state of each prefix."""
    length, link, step = [0], [-1], [{}]
    prefixes, last = [], 0
    for w in words:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = cur
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                link[q] = link[cur] = clone
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = clone
                    p = link[p]
        last = cur
        prefixes.append(cur)
    return length, link, prefixes


def heads(length: list[int], link: list[int]) -> list[int]:
    """The topmost state of the heavy path through each state."""
    n = len(length)
    order = sorted(range(1, n), key=length.__getitem__)
    below, heavy = [1] * n, [0] * n
    for v in reversed(order):
        below[link[v]] += below[v]
    for v in order:
        u = link[v]
        if not heavy[u] or below[v] > below[heavy[u]]:
            heavy[u] = v
    head = list(range(n))
    for v in order:
        if link[v] and heavy[link[v]] == v:
            head[v] = head[link[v]]
    return head


def runs_of(words: list[int], min_words: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start, then period."""
    length, link, prefixes = automaton(words)
    head = heads(length, link)
    stacks: dict[int, list[tuple[int, int]]] = {}          # per heavy path: (deepest length, colour), topmost last
    last: dict[tuple[int, int], int] = {}
    least = min_periods - 1
    for i, u in enumerate(prefixes):
        colour = -1
        while u:
            top, deep = head[u], length[u]
            stack = stacks.get(top)
            if stack is None:
                stacks[top] = [(deep, i)]
                u = link[top]
                continue
            seen = []
            while stack and stack[-1][0] <= deep:
                seen.append(stack.pop())
            if stack and (not seen or seen[-1][0] < deep):
                seen.append((deep, stack[-1][1]))          # cut: its part below goes on with its colour
            stack.append((deep, i))
            for size, j in reversed(seen):
                if j != colour:                            # the deepest state of a colour comes first
                    colour, d = j, i - j
                    if size >= least * d and size + d >= min_words:
                        last[i - size - d + 1, d] = i
            u = link[top]
    return sorted((s, e - s + 1, q) for (s, q), e in last.items())


def collapse_runs(
    docs: DataFrame, min_words: int = 6, min_periods: int = 4, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: the number of runs, the one of greatest length over period (ties: smallest
    start, then period), all of them as lines ``start,length,period``, and the words left, joined by one space."""
    if min_periods < 2:
        raise ValueError("a run has two periods at least")

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 1):
            codes, offsets, values = word_codes(part.column(1))
            found: dict[int, list[tuple[int, int, int]]] = {}
            drop = np.zeros(len(codes) + 1, np.int64)
            for text, a, b in pieces(codes, offsets, min_words, min_periods):
                for s, n, q in runs_of(codes[a:b].tolist(), min_words, min_periods):
                    drop[a + s + q] += 1
                    drop[a + s + n] -= 1
                    found.setdefault(text, []).append((a + s - int(offsets[text]), n, q))
            best = {t: min(r, key=lambda x: (Fraction(-x[1], x[2]), x[0], x[2])) for t, r in found.items()}
            keep = np.cumsum(drop)[:-1] == 0
            texts = range(part.num_rows)
            of = lambda i: pa.array([best[t][i] if t in best else None for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(found.get(t, ())) for t in texts], pa.int64()), of(0), of(1), of(2),
                 pa.array([1000 * best[t][1] // best[t][2] if t in best else None for t in texts], pa.int64()),
                 pa.array(["".join(f"{s},{n},{q}\n" for s, n, q in found.get(t, ())) for t in texts], pa.string()),
                 joined(values, codes[keep], np.r_[0, np.cumsum(keep)][offsets])],
                names=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_batches(id_text(docs, id_col, text_col), one, SCHEMA)


def plant_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A corpus with known runs: a tenth of the documents, by the checksum h of the id, repeat the p words from
    word a to their end; a and p follow from h.  Just the id and the text; the others keep theirs."""
    texts = id_text(docs, id_col, text_col)
    words = F.array_remove(F.split("text", SPLIT), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = texts.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    g = F.floor(F.col("h") / 10)
    planted = planted.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    planted = planted.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    again = F.concat(
        F.slice("w", F.lit(1), F.col("a").cast("int")),
        F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return planted.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
