"""Sum-of-squares online packing of token sequences.

Windows of a fixed number of tokens are filled online.  A level array counts the partially
filled windows at each free size; a document goes to the level (or to a fresh window) that
leaves the smallest sum of squared counts, the sum-of-squares rule of online bin packing
(Csirik, Johnson, Kenyon, Orlin, Shor, Weber, J. ACM 53(1), 2006).  The rule keeps the levels varied, so
that later documents find a fitting gap.

Every task packs its own split of the documents; nothing is shuffled and no key matters,
so a hot source or group of copies costs nothing extra.  When a split ends, the windows
still open are topped up: the emptiest give their pieces, cut where needed, to the fullest.
What then remains is at most one window per task; it is written as sequences whose lengths
are powers of two, which need no padding.

Edge cases: a null or empty text is the end id alone; a null id is kept; repeated rows are
packed each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from modlens.llm.base import id_text, slices
from modlens.llm.words import word_codes

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, capacity long"
)


class Tokens:
    """Token ids of texts by a public tokenizer that drops white space.

    Texts are split at white space, each distinct word is tokenized once per task, and the
    ids of a text are gathered from the words' ids.
    """

    # words for which the tokenizer's split and lower-casing are plain; others take the whole tokenizer
    _PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    _PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    MOST_WORDS = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.words: dict[str, np.ndarray] = {}
        self.parts: dict[str, list[int]] = {}
        self.letters: dict[str, str] = {}

    def _bytes(self, piece: str) -> str:
        """The piece in the byte alphabet of the vocabulary, letter by letter."""
        out = []
        for c in piece:
            if c not in self.letters:
                self.letters[c] = "".join(p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(c))
            out.append(self.letters[c])
        return "".join(out)

    def _part(self, piece: str) -> list[int]:
        if piece not in self.parts:
            self.parts[piece] = [t.id for t in self.model.tokenize(piece if piece.isascii() else self._bytes(piece))]
        return self.parts[piece]

    def of_word(self, word: str) -> np.ndarray:
        got = self.words.get(word)
        if got is None:
            if self._PLAIN.fullmatch(word) and "<|" not in word:
                low = word.lower()
                ids = [i for p in self._PIECES.findall(low) for i in self._part(p)]
            else:
                ids = self.whole.encode(word, add_special_tokens=False).ids
            got = self.words[word] = np.array(ids, np.uint32)
        return got

    def of_texts(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        """The ids of each text, followed by ``end``."""
        codes, offsets, values = word_codes(texts)
        if len(self.words) > self.MOST_WORDS:      # bounded memory; ids do not depend on it
            self.words.clear()
            self.parts.clear()
        per = [self.of_word(w) for w in values.to_pylist()]
        size = np.fromiter(map(len, per), np.int64, len(per))
        flat = np.concatenate(per) if per else np.zeros(0, np.uint32)
        first = np.cumsum(size) - size
        for a, b in zip(offsets[:-1], offsets[1:]):
            c = codes[a:b]
            n = size[c]
            total = int(n.sum())
            ids = np.empty(total + 1, np.uint32)
            if total:
                step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                ids[:total] = flat[np.repeat(first[c], n) + step]
            ids[total] = end
            yield ids


class Piece:
    """Some consecutive ids of one document."""

    __slots__ = ("doc_id", "start", "ids", "total")

    def __init__(self, doc_id, start: int, ids: np.ndarray, total: int):
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.total), Piece(self.doc_id, self.start + n, self.ids[n:], self.total)


class Levels:
    """Partially filled windows by free size; ``close`` gets each finished window."""

    def __init__(self, size: int, close):
        self.size, self.close = size, close
        self.count = np.zeros(size + 1, np.int64)          # the level array
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def place(self, piece: Piece) -> None:
        n, size, count = len(piece.ids), self.size, self.count
        if n == size:
            self.close([piece])
            return
        # moving a window from free size g to g - n changes the sum of squared counts by
        # 2 - 2 count[g] + 2 count[g - n]; filling it by 1 - 2 count[g]; a fresh window adds 2 count[size - n] + 1
        change = 2 - 2 * count[n:size] + 2 * count[0:size - n]
        change[0] = 1 - 2 * count[n]
        change[count[n:size] == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change)) if len(change) else -1
        if best < 0 or change[best] > 2 * count[size - n] + 1:
            free, window = size, []
        else:
            free = n + best
            window = self.open[free].pop()
            count[free] -= 1
        window.append(piece)
        if free == n:
            self.close(window)
        else:
            self.open[free - n].append(window)
            count[free - n] += 1

    def finish(self, spare: int) -> None:
        """Top up the open windows from the emptiest; gaps of up to ``spare`` stay padding."""
        rest = [(free, w) for free in range(1, self.size) for w in self.open[free]]
        lo, hi = 0, len(rest) - 1
        while lo < hi:
            free, window = rest[lo]
            while free > spare and lo < hi:
                donor = rest[hi][1]
                piece = donor.pop()
                if len(piece.ids) > free:
                    piece, left = piece.cut(free)
                    donor.append(left)
                window.append(piece)
                free -= len(piece.ids)
                if not donor:
                    hi -= 1
            if free <= spare:
                self.close(window)
                lo += 1
            else:
                rest[lo] = (free, window)
        if lo == hi and rest[lo][1]:
            self._tail(rest[lo][1], spare)

    def _tail(self, window: list[Piece], spare: int) -> None:
        """The last window in sequences of 2^j tokens, largest first, unless it is nearly full."""
        left = sum(len(p.ids) for p in window)
        if self.size - left <= spare:
            self.close(window)
            return
        window = window[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            part = []
            while room:
                piece = window.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    window.append(rest)
                part.append(piece)
                room -= len(piece.ids)
            self.close(part)


def pack(
    docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, spare: int = 4,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens, one row per piece.

    ``capacity`` is the padded length of the piece's sequence: ``size``, or the power of two
    it fills exactly.  ``spare``: a gap of so few tokens is left as padding rather than
    filled by a cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 40
        tokens = Tokens(tokenizer)
        rows: list[tuple] = []
        made = 0

        def close(window: list[Piece]) -> None:
            nonlocal made
            at, total = 0, sum(len(p.ids) for p in window)
            held = total if total & (total - 1) == 0 else size
            for p in window:
                crc = zlib.crc32(np.ascontiguousarray(p.ids, "<u4").tobytes())
                rows.append((p.doc_id, p.start, len(p.ids), crc, p.total, base + made, at, held))
                at += len(p.ids)
            made += 1

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

        levels = Levels(size, close)
        for batch in batches:
            for part in slices(batch, 1):
                ids_of = part.column(0).to_pylist()
                for doc_id, ids in zip(ids_of, tokens.of_texts(part.column(1), end)):
                    full = len(ids) - len(ids) % size
                    for a in range(0, full, size):
                        close([Piece(doc_id, a, ids[a:a + size], len(ids))])
                    if full < len(ids):
                        levels.place(Piece(doc_id, full, ids[full:].copy(), len(ids)))
                if rows:
                    yield flush()
        levels.finish(spare)
        if rows:
            yield flush()

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
