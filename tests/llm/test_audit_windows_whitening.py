"""Source divergence, window packing and whitening against plain versions and on odd rows."""

from __future__ import annotations

import collections
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import divergence
from tessera.llm.divergence import audit_sources, shared_term_pairs, terms_of
from tessera.llm.tokens import ByteEncoder
from tessera.llm.whitening import add, centred, covariance, divide, eigenpairs, fit_sums, outer_sum, total, two_product, whiten, whole_vectors
from tessera.llm.window_packing import combinations, least_squares, pack_windows, plan

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


# source divergence


def plain_audit(rows, min_docs, top):
    """The report by whole tables of all terms and sources."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    rows = [(text or "", lang or "", source or "") for _, text, lang, source, *_ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs = [(s, TERM.findall(lower(t))) for t, g, s in rows if g == lang]
        seen = collections.Counter(w for _, terms in docs for w in set(terms))
        kept = [w for w, n in seen.items() if n >= min_docs]
        count = collections.defaultdict(collections.Counter)
        for s, terms in docs:
            count[s].update(w for w in terms if seen[w] >= min_docs)
        whole = collections.Counter(w for _, terms in docs for w in terms if seen[w] >= min_docs)
        p = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        ranked = lambda found: [(v, i, k + 1) for k, (v, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())))]
        for s in count:
            pairs = ranked([(sum(f(p(count[s], w), p(count[o], w)) for w in kept), o) for o in count if o != s])
            terms = ranked([(f(p(count[s], w), p(whole, w)), w) for w in kept if count[s][w] and p(count[s], w) > p(whole, w)])[:top]
            out += [(lang, s, "pair", i, v, k) for v, i, k in pairs] + [(lang, s, "term", i, v, k) for v, i, k in terms]
    return sorted(out)


def audit_rows(n, seed=3):
    r = random.Random(seed)
    words = ["Ä", "the", "THE", "x1y", "naïve", "日本", "a-b", "q", *(f"w{chr(97 + k)}{chr(97 + j)}" for k in range(9) for j in range(9))]
    rows = [(k, " ".join(r.choices(words, k=r.randint(0, 30))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "é", None, "z"]), 1) for k in range(n)]
    return rows + rows[:7] + [(None, None, "en", "only nulls", None), (1, "", "xx", "a", 0), (1, "lone words here", "xx", "b", 0), (2, "lone", "yy", "a", 0), (3, "the " * 20_000, "en", "long", 1)]


@pytest.mark.parametrize("block_bytes", [1, 1 << 25])
def test_audit_equals_the_plain_report(spark, block_bytes):
    rows = audit_rows(300)
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(5), "term", "document", "n", "p", "value", "rank", "item", "part", "v")
    got = sorted(tuple(r) for r in audit_sources(df, min_docs=4, top_terms=5, block_bytes=block_bytes).collect())
    assert got == plain_audit(rows, 4, 5)
    assert any(r[2] == "pair" and r[4] == 0 for r in got)  # of a language that keeps no term


def test_audit_in_small_batches_with_partial_sums_given_early(spark, monkeypatch):
    rows = audit_rows(120, seed=9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(tuple(r) for r in audit_sources(spark.createDataFrame(rows, DOCS), min_docs=2).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_audit(rows, 2, 10)


def test_partial_pairs_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    r = random.Random(1)
    rows = [("en", f"t{k}".encode(), f"s{s:02}", r.randint(2, 10**9), s + 2) for k in range(60) for s in range(20) if r.random() < 0.6]
    df = spark.createDataFrame(rows, "lang string, term binary, source string, p long, p0 long").repartition(3)
    whole = sorted(tuple(x) for x in shared_term_pairs(df).collect())
    monkeypatch.setattr(divergence, "PAIRS", 40)
    assert sorted(tuple(x) for x in shared_term_pairs(df).collect()) == whole
    by = collections.defaultdict(int)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for _, t, a, p, p0 in rows:
        for _, u, b, q, q0 in rows:
            if t == u and a < b:
                by[a, b] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    assert {(a, b): v for _, a, b, v in whole} == by


def test_audit_of_no_rows(spark):
    got = audit_sources(spark.createDataFrame([], DOCS))
    assert got.collect() == [] and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shares_of_very_large_counts_are_exact(spark):
    rows = [(10**13 + 7, 3 * 10**14 + 11), (0, 1), (10**16, 10**16 + 5)]
    got = spark.createDataFrame(rows, "n long, total long").select(divergence.share("n", "total")).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 2) // t for n, t in rows]


@given(st.text())
def test_terms_by_bytes_are_those_of_the_pattern(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [t.decode() for t in terms_of(text.encode())] == ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text)]


# window packing


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\t'sdmtrevl09aéßДか́​\x85\xa0　٣Ⅷ½ª😀𝒳"))))
def test_byte_encoder_gives_the_tokenizers_ids(text):
    global _codec
    if "_codec" not in globals():
        _codec = ByteEncoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    assert np.frombuffer(_codec[0].encode([text])[0], "<u4").tolist() == _codec[1].encode(text, add_special_tokens=False).ids


def test_byte_encoder_forgets_and_knows_special_tokens():
    codec, whole = ByteEncoder(BYTE_BPE, 2, most_words=5), Tokenizer.from_file(BYTE_BPE)
    texts = ["one two three four", "five six seven eight nine ten", "a <|endoftext|> b", "", None, "one " + "x" * 500, "nine one"]
    assert [np.frombuffer(i, "<u2").tolist() for i in codec.encode(texts)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def check_packing(rows, packed, size, end):
    """Every id of every row once and in order, sequences without gaps, none padded."""
    codec = Tokenizer.from_file(BYTE_BPE)
    want = collections.Counter()
    for i, text, *_ in rows:
        ids = codec.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])
        if ids:
            want[i, tuple(ids)] += 1
    of_id, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        of_id[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (i, n), pieces in of_id.items():
        texts = [k for k in want.elements() if k[0] == i and len(k[1]) == n]
        assert sorted((s, ids) for s, ids in pieces) is not None and sum(len(x) for _, x in pieces) == n * len(texts)
        if len(texts) == 1:
            assert [x for _, ids in sorted(pieces) for x in ids] == list(texts[0][1])
        else:
            for s, ids in pieces:
                assert any(list(t[1][s : s + len(ids)]) == ids for t in texts)
    assert {(i, len(t)) for i, t in want} == set(of_id)
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes.append(at)
    short = sorted((s for s in sizes if s != size), reverse=True)
    assert all(s & (s - 1) == 0 for s in short) and len(set(short)) == len(short) and all(s < size for s in short)


@pytest.mark.parametrize(("size", "end"), [(64, 1), (2048, 1), (16, None)])
def test_windows_hold_every_id_once(spark, size, end):
    r = random.Random(size)
    rows = [(k, " ".join(f"w{r.randint(0, 99)}" for _ in range(r.randint(0, 90))), "en", "s", 0) for k in range(150)]
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (None, "no id", "en", "s", 0), (1002, "word " * 9000, "en", "s", 0), (1003, "x" * 20_000, "en", "s", 0), *rows[3:6], rows[3], (None, None, None, None, None)]
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(6), "block", "rank", "length", "start", "own", "ids", "base", "n")
    check_packing(rows, pack_windows(df, BYTE_BPE, size, end).collect(), size, end)


def test_windows_of_no_rows_and_of_wrong_sizes(spark):
    assert pack_windows(spark.createDataFrame([], DOCS), BYTE_BPE).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        pack_windows(spark.createDataFrame([], DOCS), BYTE_BPE, size=1000)


def test_crc_of_the_query_is_that_of_the_ids(spark):
    packed = pack_windows(spark.createDataFrame([(1, "some words", "en", "s", 0)], DOCS), BYTE_BPE).select("ids", F.crc32("ids").alias("c"))
    ids = Tokenizer.from_file(BYTE_BPE).encode("some words", add_special_tokens=False).ids + [1]
    assert sum(len(r["ids"]) for r in packed.collect()) == 4 * len(ids)
    assert all(zlib.crc32(r["ids"]) == r["c"] for r in packed.collect())


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_each_piece_once_and_fill_windows(seed):
    r, size = np.random.default_rng(seed), 256
    some = [1, 5, 40, 255, 60, 3][seed]
    count = {int(k): int(n) for k, n in zip(r.choice(np.arange(1, size), some, replace=False), r.integers(1, [3, 10, 50, 500, 2000, 1][seed], some, endpoint=True), strict=True)}
    rows, report = plan(dict(count), size)
    ids, filled = set(), collections.defaultdict(set)
    for j in range(len(rows["n"])):
        o, s, f, n, k, m, q, off, before = (int(rows[c][j]) for c in ("origin", "start", "first", "n", "length", "times", "sequence", "offset", "before"))
        for rank in range(f, f + n):
            turn = before + rank - f
            for x in range(k):
                assert (o, rank, s + x) not in ids
                ids.add((o, rank, s + x))
                place = off + turn % m * k + x
                assert place not in filled[q + turn // m]
                filled[q + turn // m].add(place)
    assert ids == {(k, rank, x) for k, n in count.items() for rank in range(n) for x in range(k)}
    sizes = [len(v) for v in filled.values()]
    assert all(max(v) == len(v) - 1 for v in filled.values())
    short = [s for s in sizes if s != size]
    assert len(sizes) == report["sequences"] and len(short) == len(set(short)) and all(s & (s - 1) == 0 for s in short)


def test_least_squares_meet_a_histogram_that_combinations_can_make():
    size, r = 2048, np.random.default_rng(0)
    start = {int(k): 1 for k in r.choice(np.arange(20, 1500), 400, replace=False)}
    columns = combinations({**start, **{size - k: 1 for k in start}}, size)
    assert all(sum(k * m for k, m in c) == size for c in columns)
    count = collections.Counter()
    for j in r.choice(len(columns), 3000):
        for k, m in columns[j]:
            count[k] += 40 * m
    amount, distance = least_squares(columns, dict(count)) if {k for c in columns for k, _ in c} <= set(count) else (None, None)
    if amount is None:
        columns = [c for c in columns if {k for k, _ in c} <= set(count)]
        amount, distance = least_squares(columns, dict(count))
    assert (amount >= 0).all() and distance < 0.01
    _, report = plan(dict(count), size)
    assert report["ids"] > 0.9 and report["cuts"] < 0.1 * report["sequences"]


# whitening


def exact(pair) -> Fraction:
    return Fraction(float(pair[0])) + Fraction(float(pair[1]))


def test_double_double_steps_are_exact_or_nearly_so():
    r = np.random.default_rng(0)
    a, b = r.normal(size=400) * 10.0 ** r.integers(-8, 8, 400), r.normal(size=400) * 10.0 ** r.integers(-8, 8, 400)
    p = two_product(a, b)
    assert all(exact((p[0][k], p[1][k])) == Fraction(a[k]) * Fraction(b[k]) for k in range(400))
    want = sum((Fraction(a[k]) * Fraction(b[k]) for k in range(400)), Fraction(0))
    assert abs(exact(total(p)) / want - 1) < Fraction(1, 10**25)
    s = add((a, a * 1e-17), (b, b * 1e-17))
    assert all(abs(exact((s[0][k], s[1][k])) - sum(map(Fraction, (a[k], a[k] * 1e-17, b[k], b[k] * 1e-17)))) < Fraction(1, 10**22) for k in range(400))
    q = divide((a, np.zeros(400)), 12_345)
    assert all(abs(exact((q[0][k], q[1][k])) * 12_345 / Fraction(a[k]) - 1) < Fraction(1, 10**29) for k in range(400) if a[k])
    m = outer_sum((a[:, None], np.zeros((400, 1))), (b[:, None], np.zeros((400, 1))))
    assert abs(exact((m[0][0, 0], m[1][0, 0])) / want - 1) < Fraction(1, 10**25)


def test_covariance_and_eigenpairs_where_plain_doubles_lose_digits(spark):
    r = np.random.default_rng(5)
    x = 10**15 + (r.normal(size=(60, 6)) @ np.diag([1e5, 1e5, 3e3, 40, 9, 2])).astype(np.int64)
    fit = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(7)
    n, sums = fit_sums(fit)
    assert n == 60 and sums == [sum(c) for c in x.T.tolist()]
    v = covariance(fit, n, sums)
    mean = [Fraction(s, n) for s in sums]
    want = [[sum((int(q[i]) - mean[i]) * (int(q[j]) - mean[j]) for q in x) / n for j in range(6)] for i in range(6)]
    for i in range(6):
        for j in range(6):
            assert abs(exact((v[0][i, j], v[1][i, j])) - want[i][j]) <= abs(want[i][j]) / 10**25 + Fraction(1, 10**14)
    value, axes = eigenpairs(v)
    assert (np.diff(value) <= 0).all() and np.abs(axes.T @ axes - np.eye(6)).max() < 1e-14
    for k in range(6):
        u = [Fraction(float(c)) for c in axes[:, k]]
        off = max(abs(sum(want[i][j] * u[j] for j in range(6)) - Fraction(float(value[k])) * u[i]) for i in range(6))
        assert float(off) < 1e-15 * float(value[0])


def test_refined_vectors_of_near_eigenvalues():
    r = np.random.default_rng(2)
    basis, _ = np.linalg.qr(r.normal(size=(30, 30)))
    value = np.concatenate([[3.0, 3.0 - 1e-9, 3.0 - 3e-9], np.linspace(2, 0.5, 27)])
    zero = np.zeros((30, 30))
    scaled = outer_sum((basis.T.copy(), zero), (value[:, None] * basis.T, zero))
    got, axes = eigenpairs(scaled)
    vx = outer_sum(scaled, (axes, zero))
    assert np.abs((vx[0] - axes * got) + vx[1]).max() < 3e-15
    assert np.allclose(got[:3] - 3.0, [0, -1e-9, -3e-9], atol=1e-14)


VECTORS = "vec_id long, embedding array<float>, label int"


def plain_whitening(rows, k=16):
    keep = [(i, v) for i, v, _ in rows if v and len(v) == 5 and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in keep]
    fit = sorted({tuple(v) for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)] for v in fit])
    value, axes = np.linalg.eigh(c.T @ c / n)
    value, axes = value[::-1][:k], axes[:, ::-1][:, :k]
    out = collections.Counter()
    for i, v in x:
        d = [n * a - b for a, b in zip(v, s, strict=True)]
        w = np.array([y / n for y in d]) @ axes / np.sqrt(value)
        for j in range(len(value)):
            out[i, j + 1, n, sum(y * y for y in d), round(abs(float(w[j])), 6), round(float(value[j] / value.sum()), 8)] += 1
    return out


def test_whitening_equals_a_plain_one_on_odd_rows(spark):
    r = np.random.default_rng(8)
    rows = [(k, r.normal(size=5).tolist(), 0) for k in range(200)]
    rows += rows[:40] + [(k, rows[0][1], 1) for k in range(500, 700)]  # a hot group of copies
    rows += [(None, rows[1][1], 0), (900, None, 0), (901, [], 0), (902, [1.0, None, 0.0, 0.0, 0.0], 0), (903, [float("nan")] * 5, 0), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0], 0), (905, [0.0] * 5, 0), (906, [1.0, 2.0], 0)]
    df = clashing(spark.createDataFrame(rows, VECTORS).repartition(5), "x", "n", "component", "c", "dim")
    out = whiten(df).collect()
    got = collections.Counter((q["vec_id"], q["component"], q["n"], int(q["deviation"]), round(abs(q["whitened"]), 6), round(q["explained"], 8)) for q in out)
    assert got == plain_whitening(rows)
    assert {q["identity_error"] for q in out} != set() and max(q["identity_error"] for q in out) < 1e-9 and len({q["identity_error"] for q in out}) == 1


def test_whitening_without_variance_or_rows(spark):
    assert whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, 0)], VECTORS)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)).collect() == []
    flat = whiten(spark.createDataFrame([(k, [float(k), 3.0], 0) for k in range(4)], VECTORS)).collect()
    assert {q["component"] for q in flat} == {1}  # the second entry does not vary


def test_whitening_of_very_large_entries(spark):
    rows = [(0, [1e30, 0.0], 0), (1, [-1e30, 1.0], 0), (2, [5.0, 2.0], 0)]
    x = {q["vec_id"]: q["x"] for q in whole_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert x[0][0] == (1 << 52) + 1_000_000 and x[1][0] == -(1 << 52) + 1_000_000
    out = whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(out) in (3, 6) and all(np.isfinite(q["whitened"]) for q in out)
    d, _ = centred(np.array([[1 << 62]]), 8, [1 << 60])
    assert d[0, 0] == (1 << 65) - (1 << 60)
