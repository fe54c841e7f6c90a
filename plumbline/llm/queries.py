"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, extract, filter_audit, fingerprints, language, licences, mixing, pivot_clusters, quality, suffix_dedup, tokens, toxicity
from plumbline.llm.jaccard_join import near_duplicates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4
      THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.least AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(table(spark, sf_dir, "documents"), size=50)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
part AS (SELECT doc_id, n, q, substr(h, 1024 * q + 1, 1122) AS t FROM (SELECT doc_id, h, n, unnest(range(0, (n + 511) // 512)) AS q FROM d)),
bytes AS (
  SELECT doc_id, 512 * q + k AS p, substr(t, 2 * k + 1, 2) AS b, CASE WHEN 512 * q + k + 50 <= n THEN substr(t, 2 * k + 1, 100) END AS s
  FROM (SELECT doc_id, n, q, t, unnest(range(0, least(512, n - 512 * q))) AS k FROM part)),
least AS (SELECT s, min(doc_id) AS first FROM bytes WHERE s IS NOT NULL GROUP BY s),
hit AS (
  SELECT bytes.doc_id, bytes.p, bytes.b, max(CASE WHEN least.first < bytes.doc_id THEN bytes.p END) OVER (PARTITION BY bytes.doc_id ORDER BY bytes.p ROWS UNBOUNDED PRECEDING) AS last
  FROM bytes LEFT JOIN least ON least.s = bytes.s),
marked AS (SELECT doc_id, p, b, coalesce(p - last < 50, false) AS g FROM hit),
edges AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM marked),
sums AS (
  SELECT doc_id, sum(g::INT) AS n_removed, sum(starts::INT) AS n_spans, string_agg(b, '' ORDER BY p) FILTER (NOT g) AS kept
  FROM edges GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(s.kept, ''))) AS kept_sha256
FROM d LEFT JOIN sums s USING (doc_id)
"""


def op3_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").selectExpr("doc_id", "quality as label"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, ceiling=2.0)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_pivot_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clusters.clustered(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, seed=2)


def _clustering_sql(rounds: int = 5) -> str:
    steps = [r"""WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, x AS y FROM v QUALIFY k < 40)"""]
    for r in range(rounds + 1):
        steps.append(rf"""a{r} AS MATERIALIZED (
  SELECT vec_id, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, k := k)) AS best
  FROM v, c{r} GROUP BY vec_id, x)""")
        if r < rounds:
            steps.append(rf"""m{r} AS MATERIALIZED (
  SELECT k, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(x) AS e, unnest(range(64)) AS i FROM a{r}) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.k, coalesce(m.y, c{r}.y) AS y
  FROM c{r} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM m{r} GROUP BY k) m ON m.k = c{r}.k)""")
    return ",\n".join(steps) + rf"""
SELECT a.vec_id, a.best.k::INT AS cluster, a.best.d AS distance, (sum(a.best.d) OVER (PARTITION BY a.best.k))::BIGINT AS cluster_inertia,
  (sum(a.best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.y, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.best.k
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").selectExpr("doc_id", "toxic as label"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _audit_sql() -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in itertools.permutations("ABCDE"))
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM w),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN m USING (doc_id)),
o AS (SELECT filter_order, s::INT AS step, strpos('ABCDE', filter_order[s]) AS k, list_transform(range(1, s), lambda i: strpos('ABCDE', filter_order[i])) AS before
  FROM (VALUES {orders}) v(filter_order), range(1, 6) r(s)),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
x AS (
  SELECT part, filter_order, step, k, n, good, toxic, fails[k] AS failing,
    len(list_filter(before, lambda b: fails[b])) > 0 AS gone, len(list_filter(fails, lambda b: b)) = 1 AS alone
  FROM g, o),
t AS (
  SELECT part, filter_order, step, k, sum(CASE WHEN gone OR failing THEN 0 ELSE n END)::BIGINT AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failing AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN failing AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN failing AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM t
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_quality_neighbours": op3_quality_neighbours,
        "op4_source_mixing": op4_source_mixing,
        "op5_order_minhash": op5_order_minhash,
        "op6_html_extraction": op6_html_extraction,
        "op7_language_id": op7_language_id,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_token_counts": op9_token_counts,
        "op10_licence_scan": op10_licence_scan,
        "op11_pivot_clustering": op11_pivot_clustering,
        "op12_toxicity": op12_toxicity,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": OP1_SQL,
        "op2_suffix_array_dedup": OP2_SQL,
        "op11_pivot_clustering": _clustering_sql(),
        "op13_filter_audit": _audit_sql(),
    }
