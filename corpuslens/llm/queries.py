"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, imatch, langid, ngram_lm, pii, preferences, secrets_scan, sentencepiece_codec, url_filter
from .ngram_join import jaccard_components
from .shared import read_table

#: (action, host and path) of the url rules; fixed by the query's contract.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), width=10)
    return found.drop("item_ids")


def op3_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near matches, beside op3_decontamination, whose columns are those of its SQL."""
    return decontaminate.near_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), width=10)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered(read_table(spark, sf_dir, "pages"), URL_RULES)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secrets(read_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.token_report(read_table(spark, sf_dir, "documents"), sentencepiece_codec.default_model())


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_fingerprints(read_table(spark, sf_dir, "documents"))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.neighbour_branches(read_table(spark, sf_dir, "conversations"))
    return preferences.formatted(pairs)


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.document_scores(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_predictions(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_pii, op3_decontamination, op4_url_filter, op5_secret_scan,
        op6_sentencepiece, op7_imatch, op8_preferences, op9_ngram_lm, op10_language_id, op3_proximity,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 3)), lambda i: array_to_string(w[i:i + 3], ' '))) AS g
  FROM lowered WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS whole FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reached.doc_id, edges.v FROM reached JOIN edges ON reached.other = edges.u),
groups AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  CASE WHEN n IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY whole) END AS n_copies
FROM lowered LEFT JOIN sizes USING (doc_id) LEFT JOIN groups USING (doc_id)
"""

OP3_SQL = rf"""
WITH lowered AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM lowered, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, windows.n AS n, item_id FROM starts JOIN windows ON starts.win = windows.win AND starts.n = windows.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP4_SQL = rf"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
parts AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, len(h) + 1), '^[^?#]*') AS path FROM hosts),
judged AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""

_BODY = "(x.text || '<|end|>' || chr(10))"
_HEAD = "('<|' || x.role || '|>' || chr(10))"
_SPANS = f"""{{name}} AS (
  SELECT pair_id, string_agg((done + h) || ':' || (done + h + b), ',' ORDER BY i) AS spans
  FROM (
    SELECT pair_id, i, x.role AS role, len({_HEAD}) AS h, len({_BODY}) AS b,
      coalesce(sum(len({_HEAD}) + len({_BODY})) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
    FROM (SELECT pair_id, unnest({{side}}) AS x, unnest(generate_series(1, len({{side}}))) AS i FROM sides))
  WHERE role = 'assistant' GROUP BY pair_id)"""
OP8_SQL = f"""
WITH turns AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, 'unknown'), text := coalesce(text, '')) ORDER BY turn, coalesce(role, 'unknown'), coalesce(text, '')) AS chosen
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
pairs AS (
  SELECT a.conv_id AS pair_id, a.chosen AS chosen,
    list_concat(a.chosen[1:a.conv_id % (len(a.chosen) + 1)], coalesce(b.chosen[a.conv_id % (len(a.chosen) + 1) + 1:], [])) AS rejected
  FROM turns a LEFT JOIN turns b ON xor(a.conv_id, 1) = b.conv_id),
differ AS (
  SELECT pair_id, min(i) AS i
  FROM (SELECT pair_id, chosen, rejected, unnest(generate_series(1, least(len(chosen), len(rejected)))) AS i FROM pairs)
  WHERE chosen[i].role <> rejected[i].role OR chosen[i].text <> rejected[i].text GROUP BY pair_id),
common AS (SELECT pairs.*, coalesce(differ.i - 1, least(len(chosen), len(rejected))) AS n FROM pairs LEFT JOIN differ USING (pair_id)),
sides AS (
  SELECT pair_id, n, chosen[1:n] AS p, chosen[n + 1:] AS c, rejected[n + 1:] AS r FROM common),
{_SPANS.format(name="chosen_spans", side="c")},
{_SPANS.format(name="rejected_spans", side="r")}
SELECT pair_id, CAST(n AS INTEGER) AS n_prompt_turns,
  coalesce(array_to_string(list_transform(p, lambda x: {_HEAD} || {_BODY}), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c, lambda x: {_HEAD} || {_BODY}), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(r, lambda x: {_HEAD} || {_BODY}), ''), '') AS rejected,
  coalesce(cs.spans, '') AS chosen_spans, coalesce(rs.spans, '') AS rejected_spans
FROM sides LEFT JOIN chosen_spans cs USING (pair_id) LEFT JOIN rejected_spans rs USING (pair_id)
"""

ORACLE: dict[str, str] = {"op1_ngram_jaccard_join": OP1_SQL, "op3_decontamination": OP3_SQL, "op4_url_filter": OP4_SQL, "op8_preferences": OP8_SQL}
