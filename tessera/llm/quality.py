"""Quality rules: hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Byte 4-grams of whole texts are hashed into buckets. Two multinomials, of the trusted target and
of all documents, give each bucket a log ratio; a text's score is the mean over its n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, hash_sample, shingle_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
_KEEP_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)


def hashed_ngrams(text: str | None, bits: int, n: int = 4) -> np.ndarray:
    """The bucket of each byte n-gram of a text; the whole text as one if it is shorter; none if empty."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") if text else b"", dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint32)
    k = max(1, len(raw) - n + 1)
    h = np.zeros(k, dtype=np.uint32)
    for j in range(min(n, len(raw))):
        h = (h << np.uint32(8)) | raw[j : j + k]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h >> np.uint32(32 - bits)


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    solid = b"".join(words)
    continued = np.count_nonzero((np.frombuffer(solid, dtype=np.uint8) & 0xC0) == 0x80)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) >= 4:
        h = shingle_hashes(word_hashes([raw], lower=False)[0], 3)
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        often = count[back] > 1
        if often.any():
            cover = np.zeros(len(words), dtype=bool)
            for j in range(3):
                cover[j : j + len(h)] |= often
            repeated = int(cover.sum())
    return len(words), len(solid) - int(continued), symbols, len(lines) - len(set(lines)), repeated


def ngram_ratios(docs: DataFrame, trusted: DataFrame, bits: int = 16, most_trusted: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> np.ndarray | None:
    """The log ratio of each bucket. The raw counts are of all documents, the target's of at most
    `most_trusted` trusted ids (those of the smallest hashes); both are smoothed by one. None without
    trusted texts. Null and empty texts have no n-grams; null ids are in the raw counts alone, and a
    repeated id's rows are all trusted; other columns are not read."""
    ids = trusted.select(F.col(doc_id).cast("long").alias("id")).dropna().distinct()
    ids = hash_sample(ids, F.xxhash64("id"), most_trusted)
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in ids.collect()], dtype=np.int64)))  # at most most_trusted ids
    if not len(wanted.value):
        return None

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        for b in batches(tables, 1 << 20):
            ids = b.column(0)
            good = np.isin(ids.fill_null(0).to_numpy(), wanted.value) & ~ids.is_null().to_numpy(zero_copy_only=False)
            grams = [hashed_ngrams(s, bits) for s in b.column(1).to_pylist()]
            for to, chosen in ((raw, grams), (target, [g for g, yes in zip(grams, good, strict=True) if yes])):
                if chosen:
                    to += np.bincount(np.concatenate(chosen), minlength=1 << bits)
        k = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(raw[k]), pa.array(target[k])], names=["bucket", "raw", "target"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()  # at most 2^bits rows
    got = np.ones((2, 1 << bits))
    for k, r, t in sums:
        got[:, k] += (r, t)
    if got[1].sum() == 1 << bits:
        return None
    raw, target = got / got.sum(axis=1, keepdims=True)
    return np.log(target / raw)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def judge_quality(
    docs: DataFrame, ratios: np.ndarray | None, threshold: float = -0.25, least_words: int = 50, most_repeated: int = 50, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Returns doc_id, the base measures, base_failed, llr (mean log ratio of the n-grams) and kept for each row.

    base_failed: fewer than `least_words` words, or over `most_repeated` percent of them in repeated
    3-word windows. kept: not base_failed and llr >= threshold. Null and empty texts have no words
    and an llr of 0, so they fail. Without trusted texts (ratios None) every llr is 0. Null ids and
    repeated rows are judged as any row; other columns are not read; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def judge(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        bits = 0 if table is None else int(math.log2(len(table)))
        for b in batches(tables, 2 << 20):
            out = []
            for s in b.column(1).to_pylist():
                m = base_measures(s)
                failed = m[0] < least_words or 100 * m[4] > most_repeated * m[0]
                llr = 0.0 if table is None or not s else float(table[hashed_ngrams(s, bits)].mean())
                out.append((*m, failed, llr, not failed and llr >= threshold))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *(x.split()[0] for x in MEASURES.split(", "))])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(judge, f"doc_id long, {MEASURES}")
