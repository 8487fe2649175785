"""Words of many texts at once, as codes into the list of distinct words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words, the offset of each text's first word (one more than texts), and
    the distinct words.  Words are runs without space, tab, LF, VT, FF, CR; ``lower`` maps
    A-Z only.  A null text has no words."""
    texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    flat = pc.list_flatten(lists)
    parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    enc = flat.dictionary_encode()
    codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    values = enc.dictionary
    empty = pc.index_in(pa.scalar("", values.type), value_set=values).as_py() if len(values) else None
    if empty is not None:                      # leading or trailing spaces leave empty pieces
        keep = codes != empty
        codes, parents = codes[keep], parents[keep]
    if lower:                                  # of the distinct words; those that become equal are joined
        enc = pc.ascii_lower(values).dictionary_encode()
        codes, values = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], enc.dictionary
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(parents, minlength=len(texts)), out=offsets[1:])
    return codes, offsets, values


def joined(values: pa.Array, codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of words by code, text i those from offset i to i + 1, joined by one space."""
    words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.cast(pa.string()).take(pa.array(codes)))
    return pc.binary_join(words, " ")


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def hash_words(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(v, seed) for v in values.to_pylist()), np.uint64, len(values))


def window_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries of ``h`` (empty if there are fewer).

    Order matters: each step mixes before the next entry is added.  Runs are built by
    doubling, so that k entries take about 2 log2(k) passes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, out, done, at = mix64(h ^ np.uint64(salt)), 1, None, 0, k
    while at:
        if at & 1:
            part = power[done:done + n]
            out = part.copy() if out is None else mix64(out * np.uint64(0x9E3779B97F4A7C15) + part)
            done += size
        at >>= 1
        if at:
            power = mix64(power[:-size] * np.uint64(0xD6E8FEB86659FD93) + power[size:] + np.uint64(1))
            size *= 2
    return out
