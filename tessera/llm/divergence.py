"""How sources of one language differ in their words: a sort-based streaming audit.

Each task combines its documents' terms, then rows (lang, term, source, document) are repartitioned
by (lang, term) and sorted within partitions by all four. A scan of run lengths reads them as a stream: it
adds up document frequency and occurrences of each (lang, term) run, keeps the terms in enough
documents, and emits a row for each source of the run. A second scan, over the kept runs with their groups' shares,
emits partial sums for pairs of sources that share a term. Pairs in which a source lacks a term follow
from histograms of shares, so no row is made for a term that a source does not have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, written

#: Bytes of UTF-8 that make up terms, A-Z lower-cased; all others become spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Pairs of sources that a task holds before it adds them up, and sums before it emits them.
PAIRS = 2_000_000


def terms_of(raw: bytes) -> list[bytes]:
    """The matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased, as UTF-8."""
    return raw.translate(_TERM_BYTES).split()


def combined_terms(rows: DataFrame, block_bytes: int) -> DataFrame:
    """rows (lang, source, text binary) -> (lang, term, source, document, docs, n): a block's documents of one
    (lang, term, source) as one row, named by the number of the block's first one."""

    def combine(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, first, size = TaskContext.get().partitionId() << 40, 0, 0, 0
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                m = len(n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang] * m, pa.string()), "term": pa.array(list(n), pa.binary()), "source": pa.array([source] * m, pa.string()),
                        "document": np.full(m, task + first), "docs": np.fromiter(map(docs.__getitem__, n), np.int64, m), "n": np.fromiter(n.values(), np.int64, m),
                    }
                )
            held.clear()

        for b in batches(tables, 4 << 20):
            for lang, source, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                terms = terms_of(raw)
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                docs.update(set(terms))
                seen, size = seen + 1, size + len(raw)
                if size >= block_bytes:
                    yield from flush()
                    first, size = seen, 0
        yield from flush()

    return rows.mapInArrow(combine, "lang string, term binary, source string, document long, docs long, n long")


def _changes(t: pa.Table, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before it; the first one does."""
    new = np.zeros(len(t), dtype=bool)
    new[:1] = True
    for name in names:
        col = t[name].combine_chunks()
        new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    return new


def _whole_runs(tables: Iterator[pa.RecordBatch], compact: Callable[[pa.Table], pa.Table] = lambda t: t) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole (lang, term) runs; compact() shortens what waits for a run's end."""
    waiting = None
    for b in tables:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if waiting is None else pa.concat_tables([waiting, t])
        last = int(np.flatnonzero(_changes(t, ["lang", "term"]))[-1])
        if last:
            yield t.slice(0, last)
        waiting = compact(t.slice(last))
    if waiting is not None:
        yield waiting


def _by_source(t: pa.Table) -> pa.Table:
    """One row for each (lang, term, source) run, with its sums."""
    at = np.flatnonzero(_changes(t, ["lang", "term", "source"]))
    sums = {c: np.add.reduceat(t[c].to_numpy(), at) for c in ("docs", "n")}
    return pa.table({**{c: t[c].take(at) for c in ("lang", "term", "source", "document")}, **sums})


def term_runs(docs: DataFrame, min_docs: int = 10, block_bytes: int = 32 << 20, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, source, n, lang_n, first): occurrences of each term in each source that has it, of the terms that
    occur in at least `min_docs` rows of their language; lang_n is the language's sum, first is 1 in one row of a term.

    Rows are documents, whatever their ids. Nulls count as ''; an empty text has no terms. No rows give no rows.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    combined = combined_terms(rows.withColumn("text", F.col("text").cast("binary")), block_bytes)

    def scan(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(tables, _by_source):
            t = _by_source(t)
            at = np.flatnonzero(_changes(t, ["lang", "term"]))
            size = np.diff(at, append=len(t))
            kept = np.repeat(np.add.reduceat(t["docs"].to_numpy(), at) >= min_docs, size)
            first = np.zeros(len(t), dtype=np.int32)
            first[at] = 1
            out = t.select(["lang", "term", "source", "n"]).append_column("lang_n", pa.array(np.repeat(np.add.reduceat(t["n"].to_numpy(), at), size)))
            yield from out.append_column("first", pa.array(first)).filter(pa.array(kept)).to_batches()

    ordered = combined.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return ordered.mapInArrow(scan, "lang string, term binary, source string, n long, lang_n long, first int")


def share(n: str, total: str) -> Column:
    """1 + floor(10^9 * (n + 2) / total), exact whatever n is."""
    return F.expr(f"1 + (cast({n} + 2 as decimal(20, 0)) * 1000000000) div {total}")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def shared_term_pairs(shares: DataFrame) -> DataFrame:
    """Partial sums (lang, a, b, value), a < b, over the terms that both sources have: the divergence of the pair, less what
    either source's histogram says for a source without the term."""

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // (p + q)

    def pairs(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        keys, values, held = [], [], 0

        def add_up() -> None:
            nonlocal held
            k, back = np.unique(np.concatenate(keys), return_inverse=True)
            v = np.zeros(len(k), dtype=np.int64)
            np.add.at(v, back, np.concatenate(values))
            keys[:], values[:], held = [k], [v], len(k)

        def flush() -> pa.RecordBatch:
            nonlocal held
            names = list(groups)
            a, b = (keys[0] >> 32).tolist(), (keys[0] & 0xFFFFFFFF).tolist()
            out = {"lang": [names[k][0] for k in a], "a": [names[k][1] for k in a], "b": [names[k][1] for k in b]}
            out = pa.RecordBatch.from_pydict({**{c: pa.array(v, pa.string()) for c, v in out.items()}, "value": values[0]})
            keys.clear()
            values.clear()
            held = 0
            return out

        for t in _whole_runs(tables):
            codes = [t[c].combine_chunks().dictionary_encode() for c in ("lang", "source")]
            wide = len(codes[1].dictionary)
            both, back = np.unique(codes[0].indices.to_numpy().astype(np.int64) * wide + codes[1].indices.to_numpy(), return_inverse=True)
            known = [(codes[0].dictionary[k // wide].as_py(), codes[1].dictionary[k % wide].as_py()) for k in both.tolist()]
            group = np.array([groups.setdefault(g, len(groups)) for g in known], dtype=np.int64)[back]
            p, p0 = t["p"].to_numpy(), t["p0"].to_numpy()
            at = np.flatnonzero(_changes(t, ["lang", "term"]))
            size = np.diff(at, append=len(t))
            for s in np.unique(size[size > 1]).tolist():
                of_size = at[size == s]
                step = max(1, (1 << 18) // s)
                for k in range(0, len(of_size), step):
                    rows = of_size[k : k + step, None] + np.arange(s)
                    for i in range(s - 1):
                        a, b = rows[:, i, None], rows[:, i + 1 :]
                        value = apart(p[a], p[b]) - apart(p[a], p0[b]) - apart(p0[a], p[b]) + apart(p0[a], p0[b])
                        keys.append(((group[a] << 32) + group[b]).ravel())
                        values.append(value.ravel())
                        held += value.size
                        if held > PAIRS:
                            add_up()
                            if held > PAIRS // 2:
                                yield flush()
        if held:
            add_up()
            yield flush()

    ordered = shares.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    partial = ordered.mapInArrow(pairs, "lang string, a string, b string, value long")
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = 10, top_terms: int = 10, block_bytes: int = 32 << 20, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Returns lang, source, part, item, value, rank: for each source of a language every other one by divergence
    (`pair`), and the terms that set it most apart from the language (`term`, ranks up to top_terms).

    All arithmetic is of whole numbers. Nulls in text, lang and source count as ''. Rows are documents, whatever their
    ids; repeated rows count as often as they occur; ties are ordered by the item's bytes. A source without kept terms
    has pairs; a language without any has pairs of value 0; a lone source has none. Other columns are not
    read. No rows give no rows.
    """
    runs = written(term_runs(docs, min_docs, block_bytes, text, lang, source), "term-runs")
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    of_group = runs.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    of_lang = runs.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("v"))
    groups = occurring.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "terms", "lang_total", "v"])
    groups = groups.withColumn("total", F.expr("nullif(n + 2 * v, 0)")).withColumn("p0", share("0L", "total"))
    groups = written(groups.select("lang", "source", "terms", "v", "total", F.expr("nullif(lang_total + 2 * v, 0)").alias("lang_total"), "p0"), "term-groups")

    shares = runs.join(groups, ["lang", "source"]).withColumn("p", share("n", "total")).withColumn("q", share("lang_n", "lang_total"))
    shares = written(shares.select("lang", "term", "source", "p", "p0", "q"), "term-shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), divergence("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("q0"))
    missing = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n")).join(other, "lang").where("source <> b")
    missing = missing.select("lang", F.col("source").alias("a"), "b", (F.col("n") * (divergence("p", "q0") - divergence("p0", "q0"))).alias("value"))
    missing = missing.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one_way = missing.unionByName(shared_term_pairs(shares))
    none = groups.join(other, "lang").where("source <> b")
    none = none.select("lang", F.col("source").alias("a"), "b", F.coalesce(F.col("v") * divergence("p0", "q0"), F.lit(0)).alias("value"))
    pairs = none.unionByName(one_way).unionByName(one_way.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)
