"""One query an operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding, html, langid, lm, minhash, mixing, packing, quality, rules, suffix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_dedup(_table(spark, sf_dir, "documents"), percent=85)


@_query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(_table(spark, sf_dir, "documents"))


@_query
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embedding_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.93)


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(1, 2, 3))
    return mixing.in_training_order(mixed).select("doc_id", "size", "source_size", "target", "taken", "source", "position")


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.public_tokenizer())


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no URL: a site's host is the source, its path the language."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, host=F.col("source"), path=F.col("lang"))


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"))


@_query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(_table(spark, sf_dir, "documents"))


@_query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


ORACLES["op10_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
  ws AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x09-\x0d\x20]+'), lambda x: x <> '') AS ws FROM d),
  w AS (SELECT rid, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM ws),
  g AS (SELECT rid, pos, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
  c AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL),
  r AS (SELECT rid, count(DISTINCT pos + k) AS n FROM c, (VALUES (0), (1), (2)) AS v(k) WHERE c.n > 1 GROUP BY rid),
  wn AS (SELECT rid, count(*) AS n, sum(length(w)) AS chars, count(*) FILTER (NOT regexp_matches(w, '[A-Za-z]|[^\x00-\x7f]')) AS bare FROM w GROUP BY rid),
  kc AS (SELECT rid, count(DISTINCT (pos * greatest(1, n // 2000) // n, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS kinds FROM w JOIN wn USING (rid) GROUP BY rid),
  wc AS (SELECT * FROM wn JOIN kc USING (rid)),
  l AS (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d),
  lc AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM l WHERE regexp_matches(x, '[^\x09-\x0d\x20]') GROUP BY rid),
  m AS (SELECT d.doc_id, t, coalesce(wc.n, 0) AS n_words, coalesce(wc.chars, 0) AS word_chars, coalesce(wc.kinds, 0) AS kinds, coalesce(wc.bare, 0) AS bare,
      len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(lc.dup, 0) AS n_dup_lines, coalesce(lc.n, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words,
      len(regexp_extract_all(t, '[A-Z]')) AS upper, len(regexp_extract_all(t, '[A-Za-z]')) AS letters,
      length(t) - length(replace(replace(t, '!', ''), '?', '')) AS exclaiming
    FROM d LEFT JOIN wc USING (rid) LEFT JOIN lc USING (rid) LEFT JOIN r USING (rid)),
  b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > word_chars OR (2 * n_dup_lines > n_lines AND n_dup_lines >= 3) OR NOT (2 * n_words <= word_chars AND word_chars <= 25 * n_words)
    OR (10 * upper > 6 * letters AND letters > 0) OR 10 * exclaiming > 3 * n_words OR 5 * bare > n_words OR (n_words >= 50 AND 20 * kinds < n_words)) AS kept
FROM b"""


# every 200-byte string of every text, so for small tables only
ORACLES["op4_suffix_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
  s AS (SELECT rid, unnest(range(octet_length(b) - 199)) AS p, b FROM d WHERE octet_length(b) >= 200),
  g AS (SELECT rid, p, md5_number(b[p + 1 : p + 200]) AS g FROM s),
  r AS (SELECT rid, p FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
  i AS (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM r),
  n AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS k FROM i),
  k AS (SELECT rid, k, min(p) AS a, max(p) + 200 AS z FROM n GROUP BY rid, k),
  e AS (SELECT rid, a, z FROM k UNION ALL SELECT rid, octet_length(b), octet_length(b) FROM d),
  l AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a, z), 0) AS a, a AS z FROM e),
  h AS (SELECT rid, string_agg(hex(b[a + 1 : z]), '' ORDER BY a) AS kept, sum(z - a) AS n FROM l JOIN d USING (rid) GROUP BY rid),
  c AS (SELECT rid, count(*) AS n FROM k GROUP BY rid)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(octet_length(b) - h.n AS BIGINT) AS n_removed, coalesce(c.n, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN h USING (rid) LEFT JOIN c USING (rid)"""

# every pair of documents that share a shingle, so for small tables only
ORACLES["op1_minhash_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0d\x20]+'), lambda x: x <> '') AS ws FROM documents),
  s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) BETWEEN 1 AND 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k : k + 4], ' ')) END)) AS g FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
  c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""

ORACLES["op3_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0d\x20]+'), lambda x: x <> '')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
  k AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
  w AS (SELECT source, source_size, [1, 2, 3][r % 3 + 1]::DOUBLE AS w, [0.5, 1.0, 1.5][r % 3 + 1]::DOUBLE AS ramp, 3.0::DOUBLE * source_size AS cap FROM k),
  -- sources that reach their caps are found one level after another
  v AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS total, row_number() OVER o AS k
    FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
  lv AS (SELECT arg_min((total - filled) / open, k) FILTER (WHERE (total - filled) / open <= cap / w) AS share FROM v),
  t AS (SELECT source, source_size, ramp, least(cap, coalesce(share * w, cap)) AS target FROM w, lv),
  s AS (SELECT d.*, source_size, target, ramp, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  p AS (SELECT *, least(round(target)::BIGINT, 3 * source_size) AS words FROM s),
  q AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes, least(1.0::DOUBLE, (start + size / 2::DOUBLE) / greatest(target, 1.0::DOUBLE)) AS due FROM p)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, words - passes * source_size - start)))::BIGINT AS taken, source,
  2 * due / (ramp + sqrt(greatest(0.0::DOUBLE, ramp * ramp + 4 * (1 - ramp) * due))) AS position FROM q"""

# every pair of vectors of a label, so for small tables only
ORACLES["op8_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
  ok AS (SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  r(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
  c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM v LEFT JOIN n USING (vec_id) JOIN c USING (vec_id)"""
