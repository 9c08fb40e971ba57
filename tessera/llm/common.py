"""Shared helpers of the corpus operators: scratch tables, words and hashing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import attach, discard, scratch_path, table, written  # noqa: F401


def hash_share(df: DataFrame, hashed: Column, about: int) -> DataFrame:
    """About `about` rows of df (all, if there are no more), those of the smallest hashes; `hashed` is a
    uniform signed 64-bit column. A filter alone: no sort, no shuffle."""
    n = df.count()
    return df.where(hashed < F.lit(int(-(1 << 63) + (1 << 64) * about / n))) if n > about else df


def hash_sample(df: DataFrame, hashed: Column, most: int) -> DataFrame:
    """At most `most` rows, those of the smallest hashes. What is sorted, about twice as many, does not
    grow with the table, as the first rows of all its partitions would."""
    return hash_share(df, hashed, 2 * most).orderBy(hashed).limit(most)


def fold_of(ids: list, modulus: int) -> np.ndarray:
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % modulus for i in ids], dtype=np.int64)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def sized_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes and sizes in bytes of the words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased, if asked) of all texts, and where
    each text's words begin (and the last text's end). Eight bytes of all words are taken at a time, and no
    word becomes an object."""
    raw = b"\n".join(texts) + b" " * 9
    raw = raw.lower() if lower else raw  # bytes.lower knows ASCII only
    a = np.frombuffer(raw, dtype=np.uint8)
    space = (a == 32) | ((a - np.uint8(9)) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    begins, size = edges[::2], edges[1::2] - edges[::2]
    starts = np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    on = np.flatnonzero(size <= LONG_WORD)
    with np.errstate(over="ignore"):
        for k in range(0, LONG_WORD, 8):
            if not len(on):
                break
            left = size[on] - k
            out[on] = mix((out[on] ^ (eights[begins[on] + k] & _MASKS[np.minimum(left, 8)])) * np.uint64(0xD6E8FEB86659FD93))
            on = on[left > 8]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[begins[k] : begins[k] + size[k]])
    return out, size, starts


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    out, _, starts = sized_words(texts, lower)
    return out, starts


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as set it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-word windows, in order; the whole sequence as one if it is shorter."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        k = len(words) - n + 1
        h = np.full(k, np.uint64(n))
        for j in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + k])
    return h


def batches(tables: Iterator, most_bytes: int) -> Iterator:
    """Arrow record batches cut to at most about `most_bytes` each; one row stays one row."""
    for b in tables:
        rows = max(1, b.num_rows * most_bytes // max(b.nbytes, 1))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
