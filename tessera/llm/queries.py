"""The queries of the corpus operators, as the driver registers them, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table
from .divergence import audit_sources
from .jaccard_join import jaccard_components
from .language_model import score_texts
from .mixing import mix_sources
from .packing import pack_documents
from .pii import KINDS, find_spans, fit_tagger
from .quality import judge_quality, ngram_ratios
from .token_files import read_token_files, write_token_files
from .toxicity import fit_toxicity, score_toxicity
from .url_filters import judge_urls
from .vector_forest import link_vectors
from .whitening import whiten
from .window_packing import pack_windows


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = ngram_ratios(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return judge_quality(docs, ratios)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _key(u: str) -> str:
    """SQL of the page key of a url."""
    host = f"regexp_replace(translate(coalesce(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\\.', '')"
    rest = f"regexp_replace(regexp_extract({u}, '^.*?://[^/?#]*([^#]*)', 1, 's'), '^(.+)/$', '\\1', 's')"
    return f"CASE WHEN contains({u}, '://') THEN {host} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"


#: Of relative links it knows those from the root alone.
OP2_SQL = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, {_key("url")} AS key,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) t(rule, rhost, rpath, verdict)),
t AS (SELECT url AS a, unnest(regexp_extract_all(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is')) AS tag, 'href' AS name FROM p
  UNION ALL SELECT url, unnest(regexp_extract_all(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is')), 'url' FROM p),
l AS (SELECT a, replace(CASE name WHEN 'href' THEN regexp_extract(tag, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is') ELSE regexp_extract(tag, '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is') END, '&amp;', '&') AS b FROM t),
w AS (SELECT a, CASE WHEN regexp_matches(b, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN b WHEN starts_with(b, '/') THEN regexp_extract(a, '^(.*?://[^/?#]*)', 1, 's') || b END AS b FROM l),
e AS (SELECT DISTINCT {_key("a")} AS a, {_key("b")} AS b FROM w),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
k AS (SELECT key, host, path FROM p WHERE key IS NOT NULL UNION SELECT a, regexp_extract(a, '^([^/?]*)', 1, 's'), regexp_extract(a, '^[^/?]*([^?]*)', 1, 's') FROM s),
v AS (SELECT key, (SELECT verdict FROM r WHERE (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) ORDER BY length(rule) DESC LIMIT 1) AS verdict FROM k),
c AS (SELECT DISTINCT key AS n, key AS m FROM k UNION SELECT c.n, s.b FROM c JOIN s ON c.m = s.a),
g AS (SELECT n, bool_or(verdict = 'allow') AS allows, bool_or(verdict = 'block') AS blocks FROM c JOIN v ON v.key = c.m GROUP BY n)
SELECT page_id, host, path,
  (SELECT rule FROM r WHERE (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) ORDER BY length(rule) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM r WHERE (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) ORDER BY length(rule) DESC LIMIT 1),
    CASE WHEN allows THEN 'allow' WHEN blocks THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN g ON g.n = p.key
"""


TOKENIZER = "word_bpe_49k.json"


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end=1)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "taken")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_spans(docs, fit_tagger(docs))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["by"] == "base")
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    more = [F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda s: s["by"] != "base")).cast("long").alias("n_added")]
    return found.select("doc_id", *counts, F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), *more)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), size=2048, end=0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return score_toxicity(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t SEMI JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
s AS (
  SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (m.n + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q
  FROM m JOIN v ON m.lang = v.lang JOIN k ON k.lang = m.lang LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM o QUALIFY part = 'pair' OR rank <= 10
"""


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_windows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(table(spark, sf_dir, "embeddings"))
    return white.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op11_source_divergence": OP11_SQL}
