"""Queries of the pipeline operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fim, fingerprints, genetic_packing, html_extract, license_scan, mil_quality, mixing, ngram_join, quality_rules, resharding, sp_sampling, suffix_dedup
from .staging import documents, prepare

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        return fn
    return deco


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_rules.apply_rules(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["script", "n_tokens", "chars_per_token", "fallback_share", "token_entropy", "second_chars_per_token"]
    return docs.select("doc_id", *(F.col(f"quality.{c}") for c in base), "base_failed", "kept",
                       *(F.col(f"quality.{c}") for c in more))


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


#: All pairs that share a shingle, and everything reachable from each document.
ORACLE["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT reach.doc_id, v FROM reach JOIN links ON links.u = reach.node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, coalesce(l.n_links, 0) AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
LEFT JOIN (SELECT u AS doc_id, count(*) AS n_links FROM links GROUP BY u) l USING (doc_id)
"""


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.summary(documents(spark, sf_dir))


#: Every 100-byte string of every text, those seen before, and the runs that they cover.
ORACLE["op4_suffix_dedup"] = r"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
strings AS (
  SELECT r, i, b[i + 1:i + 100] AS s
  FROM (SELECT r, b, unnest(range(0, octet_length(b) - 99)) AS i FROM docs WHERE octet_length(b) >= 100)),
again AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS k FROM strings) WHERE k > 1),
marked AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM again),
spans AS (
  SELECT r, min(i) AS a, max(i) + 100 AS z
  FROM (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS span FROM marked) GROUP BY r, span),
cut AS (
  SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans,
         string_agg(CASE WHEN a > before THEN hex(b[before + 1:a]) ELSE '' END, '' ORDER BY a) AS k, max(z) AS last
  FROM cut JOIN docs USING (r) GROUP BY r)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN k IS NULL THEN sha256(d.b)
            ELSE sha256(unhex(k || CASE WHEN last < octet_length(d.b) THEN hex(d.b[last + 1:octet_length(d.b)]) ELSE '' END)) END AS kept_sha256
FROM docs d LEFT JOIN kept USING (r)
"""


@query("op1_source_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    # short blocks: the draws of small tables stay nearer to their targets
    return mixing.mix(documents(spark, sf_dir), block=32, shard_slots=8192).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(documents(spark, sf_dir))


@query("op6_flow_resharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.reshard(documents(spark, sf_dir))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *(F.col(f"license.{c}") for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")),
                        F.size("license.matches").alias("n_blocks"))


@query("op7_mil_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mil_quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op2_sentencepiece_sampling")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(sp_sampling.ROWS))
    return sp_sampling.digests(docs)


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"))


@query("op11_source_divergence")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


ORACLE["op11_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT rid, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
each AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p
  FROM each JOIN sizes USING (lang)),
langs AS (SELECT lang, term, sum(n) AS n FROM each GROUP BY ALL),
of_lang AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM langs JOIN sizes USING (lang)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value
  FROM shares JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op13_fill_in_middle")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.digests(documents(spark, sf_dir))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE["op13_fill_in_middle"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM docs),
parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:least(c1, c2)], ''), '') AS prefix,
         coalesce(array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS middle,
         coalesce(array_to_string(u[greatest(c1, c2) + 1:n], ''), '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query("op12_genetic_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genetic_packing.packed(documents(spark, sf_dir))
