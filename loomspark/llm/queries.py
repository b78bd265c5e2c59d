"""The queries ``opN_...``: each applies one operator to its whole table.

``SQL`` has what DuckDB can say about the same rows. Where it has nothing, ``tests/llm``
holds the query against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import (
    bpe_count,
    class_lm,
    decontaminate,
    fingerprint,
    mixing,
    page_diff,
    parity_join,
    ring_shards,
    runs,
    token_files,
    token_links,
    toxicity,
    url_filter,
)
from loomspark.llm.tables import fresh_folder, table

#: Production parameters.
ALLOW, BLOCK = ["com/", "www.example.com/en/"], ["example.com/en/", "net/es/", "net/fr/"]
WINDOW = 10
LABELLED_ROWS = 20_000
TOKENIZER, PIECES, TOKEN_LIMIT = "byte_bpe_50k.json", "piece_bpe_32k.model", 512
SHINGLE_WORDS, PERCENT = 4, 85
SHARDS, VNODES = 40, 64
LEAST_RUN, POWERS = 6, 4
WEIGHTS, DEFAULT_WEIGHT = {"src0": 3.0, "src1": 2.0, "src2": 0.5}, 1.0

ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), ALLOW, BLOCK)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW)
    return found.drop("spans")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, DEFAULT_WEIGHT)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), LABELLED_ROWS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), TOKEN_LIMIT)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf_dir, "documents"), SHINGLE_WORDS, PERCENT)


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards.assign_shards(table(spark, sf_dir, "documents"), SHARDS, VNODES)


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(table(spark, sf_dir, "pages"))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_lm_scores(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(table(spark, sf_dir, "documents"), LEAST_RUN, POWERS, runs.repeated_tail)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_folder(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), root, public_tokenizers.path(TOKENIZER))
    return token_files.documents_of(spark, root)


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_decontamination, op3_source_mixing, op4_fingerprints, op5_toxicity, op6_token_counts, op7_jaccard_join, op8_ring_shards, op9_page_text, op10_class_lm, op11_periodic_runs, op12_token_files, op13_token_links)}

#: The rules of op1 as (host, path, rule, verdict).
RULE_ROWS = ", ".join(
    f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for v, rules in (("allow", ALLOW), ("block", BLOCK)) for r in rules
)

SQL = {
    "op1_url_filter": rf"""
WITH rules(rule_host, rule_path, rule, verdict) AS (VALUES {RULE_ROWS}),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {ABC}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
best AS (
  SELECT p.n, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY p.n)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (n)
""",
    "op2_decontamination": rf"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(cast(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(list_slice(w, k, k + {WINDOW} - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (
  SELECT n, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS win
  FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT s.n, s.k, s.size, v.item FROM spots s JOIN windows v USING (size, win)),
hit AS (SELECT n, count(DISTINCT spot) AS n_hit FROM (SELECT n, unnest(range(k, k + size)) AS spot FROM found) GROUP BY n),
ids AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT n, item FROM found) GROUP BY n)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items,
       sha256(coalesce(x.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h USING (n) LEFT JOIN ids x USING (n)
""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT n, array_to_string(list_slice(w, k, k + {SHINGLE_WORDS} - 1), ' ') AS shingle
  FROM (SELECT n, w, unnest(range(1, greatest(len(w) - {SHINGLE_WORDS} + 1, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
sizes AS (SELECT n, count(*) AS size FROM s GROUP BY n),
common AS (SELECT a.n AS a, b.n AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.n < b.n GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.n = a JOIN sizes y ON y.n = b WHERE 100 * c >= {PERCENT} * (x.size + y.size - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT DISTINCT a AS n, a AS m FROM both_ways UNION SELECT r.n, l.b FROM reached r JOIN both_ways l ON l.a = r.m),
smallest AS (SELECT r.n, min(d.doc_id) AS component_id FROM reached r JOIN d ON d.n = r.m GROUP BY r.n)
SELECT d.doc_id, coalesce(sizes.size, 0) AS n_shingles, coalesce(smallest.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (n) LEFT JOIN smallest USING (n)
""",
    "op3_source_mixing": f"""
WITH sized AS (
  SELECT *, coalesce(source, '(null)') AS src,
         coalesce(cast(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS document
  FROM documents),
sizes AS (SELECT src, sum(coalesce(length(text), 0)) AS size FROM sized GROUP BY src),
weighted AS (
  SELECT src, size, CASE WHEN size = 0 THEN 0.0 {" ".join(f"WHEN src = '{s}' THEN {w}" for s, w in sorted(WEIGHTS.items()))} ELSE {DEFAULT_WEIGHT} END::DOUBLE AS weight
  FROM sizes),
rates AS (
  SELECT src, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(size) FROM weighted)::DOUBLE / size ELSE 0.0 END AS rate
  FROM weighted),
parts AS (SELECT src, rate, greatest(1, ceil(rate / {mixing.PART}))::INTEGER AS parts FROM rates),
terms AS (
  SELECT src, k, CASE WHEN rate > 0 THEN exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)) ELSE (k = 0)::INTEGER::DOUBLE END AS p
  FROM parts, (SELECT unnest(range(0, {mixing.TERMS + 1})) AS k)),
sums AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM terms),
lists AS (SELECT src, list(c ORDER BY k) AS cs FROM sums GROUP BY src),
drawn AS (
  SELECT s.*, list_sum([len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('mix:' || part || ':' || document), 1, 13))::BIGINT / 4503599627370496.0)) for part in range(1, parts + 1)])::INTEGER AS mix_copies
  FROM sized s JOIN parts USING (src) JOIN lists USING (src)),
copies AS (SELECT *, unnest(range(1, mix_copies + 1))::INTEGER AS mix_copy FROM drawn WHERE mix_copies > 0)
SELECT doc_id, text, lang, source, n_chars, mix_copies, mix_copy,
       ('0x' || substr(md5('mix:order:' || document || ':' || mix_copy), 1, 15))::BIGINT AS mix_key
FROM copies
""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return QUERIES | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
