"""One query for each operator over its whole table, and the SQL it must agree with (where SQL can)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from titleworks.llm import quality, toxicity
from titleworks.llm.context_trees import score
from titleworks.llm.divergence import divergence
from titleworks.llm.exact_copies import exact_copies
from titleworks.llm.filter_audit import filter_audit
from titleworks.llm.leaks import find_leaks
from titleworks.llm.lengths import encoded_lengths, length_table
from titleworks.llm.licences import licences
from titleworks.llm.licences import train as train_licences
from titleworks.llm.mixing import mix, sizes, sources_of, targets
from titleworks.llm.near_copies import near_copies
from titleworks.llm.schedules import weighed
from titleworks.llm.text import remainder
from titleworks.llm.token_files import read_documents, write_token_files
from titleworks.llm.url_rules import Rule, judge
from titleworks.llm.vocabulary import END_ID, VOCABULARY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPACE = r"[\x20\x09-\x0D]"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [Rule("net/", False), Rule("example.net/en/", True), Rule("example.com/de/", False), Rule("org/fr/", True)]


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    found = judge(pages, URL_RULES)
    verdict = F.when(F.col("url_allowed"), "allow").otherwise("block")
    return found.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), verdict.alias("verdict"))


QUERIES["op2_url_rules"] = op2_url_rules
ORACLES["op2_url_rules"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
"""


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES["op3_near_copies"] = op3_near_copies
ORACLES["op3_near_copies"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_FOLD}, '{_SPACE}+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s
  FROM words),
sets AS (SELECT list_sort(s) AS s, min(doc_id) AS set_id, len(any_value(s)) AS n FROM shingles WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS (SELECT set_id, n, unnest(s) AS x FROM sets),
common AS (SELECT a.set_id AS a, b.set_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.set_id < b.set_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT set_id AS node, set_id AS to_id FROM sets UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.to_id),
label AS (SELECT node, min(to_id) AS component FROM reach GROUP BY node)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id, d.doc_id = coalesce(l.component, d.doc_id) AS kept
FROM shingles d LEFT JOIN sets t ON list_sort(d.s) = t.s LEFT JOIN label l ON l.node = t.set_id
"""


def op10_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(_table(spark, sf_dir, "documents"))


QUERIES["op10_exact_copies"] = op10_exact_copies
ORACLES["op10_exact_copies"] = rf"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS sha FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY sha ORDER BY points DESC, doc_id) AS place, count(*) OVER (PARTITION BY sha) AS group_size FROM normal)
SELECT p.doc_id, k.doc_id AS keep_id, p.group_size, p.doc_id = k.doc_id AS kept, p.sha AS text_sha256
FROM placed p JOIN placed k ON k.sha = p.sha AND k.place = 1
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(encoded_lengths(_table(spark, sf_dir, "documents"), VOCABULARY))


QUERIES["op6_token_counts"] = op6_token_counts


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(_table(spark, sf_dir, "documents"), VOCABULARY, END_ID)
    return read_documents(manifest).drop("part")


QUERIES["op9_token_files"] = op9_token_files


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = sizes(_table(spark, sf_dir, "documents"))
    plan = mix(entries, targets(weighed(sources_of(entries))))
    plan = plan.withColumns({"taken": F.col("size") * F.col("takes"), "first_position": F.get("positions", F.lit(0)), "_": F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))})
    return plan.orderBy(F.asc_nulls_last("first_position"), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "source", "first_position")


QUERIES["op1_mixing"] = op1_mixing


def op8_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 7) == 2
    rows = score(_table(spark, sf_dir, "documents"), ~held_out)
    bits = -F.col("score") * F.lit(math.log2(10)) / (F.col("n_bytes") + 1)
    return rows.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))


QUERIES["op8_context_trees"] = op8_context_trees


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 3) == 1
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


QUERIES["op4_quality"] = op4_quality


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.common", "leak.words", "leak.cosine")


QUERIES["op7_leaks"] = op7_leaks


QUERIES["pipeline"] = corpus_pipeline.run


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences(docs, train_licences(docs))


QUERIES["op5_licences"] = op5_licences


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


QUERIES["op11_divergence"] = op11_divergence
ORACLES["op11_divergence"] = rf"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row, {_FOLD} AS folded FROM documents),
words AS (SELECT lang, source, row, unnest(regexp_extract_all(folded, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
per_doc AS (SELECT lang, source, row, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS all_n FROM per_doc GROUP BY ALL HAVING count(*) >= 30),
found AS (SELECT lang, source, term, sum(n) AS n FROM per_doc GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, k.all_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
shares AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // (sum(n) OVER own + 5 * count(*) OVER own)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (all_n + 5)::HUGEINT) // (sum(all_n) OVER own + 5 * count(*) OVER own)::HUGEINT AS q
  FROM counts WINDOW own AS (PARTITION BY lang, source)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
valued AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM valued)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op12_filter_audit"] = op12_filter_audit
ORACLES["op12_filter_audit"] = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w
  FROM documents),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    if(len(w) < 200, 1, 0) + if(100 * len(list_distinct(w)) < 50 * len(w), 2, 0) + if(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), 4, 0)
    + if(regexp_matches(t, '[#$%&*|]'), 8, 0) + if(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false), 16, 0) AS bits
  FROM docs LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, bits, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order, total, step, bit, before) AS (
  SELECT letter, bit, 1, bit, 0 FROM letters
  UNION ALL SELECT o.filter_order || l.letter, o.total + l.bit, o.step + 1, l.bit, o.total FROM orders o JOIN letters l ON o.total & l.bit = 0),
steps AS (SELECT f.filter_order, o.step, o.bit, o.before FROM orders f JOIN orders o ON starts_with(f.filter_order, o.filter_order) WHERE f.step = 5),
counts AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (bits & (bit | before) = 0) AS kept, sum(n) FILTER (bits & bit > 0 AND bits & before = 0) AS removed,
    sum(n) FILTER (bits & bit > 0 AND bits & before > 0) AS redundant, sum(n) FILTER (bits = bit) AS unique_fails,
    sum(n) FILTER (bits & bit > 0 AND bits & before = 0 AND good) AS good_lost, sum(n) FILTER (bits & bit > 0 AND bits & before = 0 AND toxic) AS toxic_lost
  FROM cells JOIN steps ON true GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM counts
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 4) == 2
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held_out), ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"))


QUERIES["op13_toxicity"] = op13_toxicity
