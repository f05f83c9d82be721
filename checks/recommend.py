"""Picks from the documents, their evaluation, and the lookups over titles and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import tables as X
from checks.catalog import BASE
from checks.registry import check, once
from titleworks.functions import titles as K
from titleworks.operators import text_vectors as V
from titleworks.plans import lookup as L
from titleworks.plans import marts as M
from titleworks.plans import recommender as R
from titleworks.session import settle, working_path
from titleworks.sources import sinks as S

STOP = "[" + ", ".join(f"'{w}'" for w in V.STOP_WORDS) + "]"
FILLER = "[" + ", ".join(f"'{w}'" for w in K.FILLER_WORDS) + "]"
WORDS = rf"list_filter(string_split(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT list_contains({FILLER}, w))"
DOCS = rf"""WITH {X.DOCS_SQL}, {X.DOC_LINKS_SQL},
d AS (SELECT *, score IS NOT NULL AND members >= 1000 AS eligible, {WORDS} AS words,
  CASE WHEN regexp_matches(synopsis, '(?i)^\s*no synopsis (information )?has been added') THEN NULL WHEN regexp_matches(synopsis, '^\s*$') THEN NULL ELSE synopsis END AS words_from FROM docs),
p AS (SELECT mal_id, title, eligible, words_from, nullif(array_to_string(words[1:2], ' '), '') AS key, words[1] AS one,
  CASE WHEN len(words) >= 2 THEN words[1] || ' ' || words[2] END AS two, least(len(words), 2) AS size,
  coalesce(nullif(array_to_string(words[1:2], ' '), ''), '#' || mal_id) AS slot FROM d)"""
TEXT = DOCS + rf""",
tok AS (SELECT mal_id, list_filter(regexp_extract_all(lower(words_from), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOP}, w)) AS ws FROM p WHERE words_from IS NOT NULL),
terms AS (SELECT mal_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM tok),
tf AS (SELECT mal_id, term, count(*) AS tf FROM terms GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 30000),
weighted AS (SELECT mal_id, term, tf * (ln((1 + (SELECT count(*) FROM p)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term)),
v AS (SELECT mal_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY mal_id)) AS w FROM weighted),
tags AS (SELECT DISTINCT mal_id, tag FROM doc_links WHERE kind IN ('genre', 'theme', 'demographic') AND tag <> 'Award Winning'),
g AS (SELECT mal_id, tag, 1 / sqrt(count(*) OVER (PARTITION BY mal_id)) AS w FROM tags)"""
SPOT_IDS = "(SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5)"


def asked_of(table: str, asking: str | None) -> str:
    return table if asking is None else f"(SELECT * FROM {table} SEMI JOIN asking USING (mal_id))"


def cosines_sql(asking: str | None) -> str:
    """Cosines of every title, or of those that ask, with every candidate."""
    chosen = "" if asking is None else f",\nasking AS (SELECT mal_id FROM p WHERE {asking})"
    return TEXT + chosen + f""",
text_pairs AS (SELECT q.mal_id AS q, c.mal_id AS c, round(sum(q.w * c.w), 9) AS cosine FROM {asked_of('v', asking)} q JOIN v c USING (term) JOIN p e ON e.mal_id = c.mal_id AND e.eligible GROUP BY ALL),
tag_pairs AS (SELECT q.mal_id AS q, c.mal_id AS c, round(sum(q.w * c.w), 9) AS cosine FROM {asked_of('g', asking)} q JOIN g c USING (tag) JOIN p e ON e.mal_id = c.mal_id AND e.eligible GROUP BY ALL)"""


SERIES = "coalesce(CASE q.size WHEN 2 THEN q.two = c.two WHEN 1 THEN q.one = c.one ELSE FALSE END, FALSE)"


def blend_sql(skip_series: bool, asking: str | None = None) -> str:
    rule = f"AND NOT {SERIES}" if skip_series else ""
    share = lambda c: f"CASE WHEN min({c}) OVER q = max({c}) OVER q THEN 0 ELSE (rank() OVER (PARTITION BY q ORDER BY {c}) + (count(*) OVER (PARTITION BY q, {c}) - 1) / 2.0 - 1) / greatest(count(*) OVER q - 1, 1) END"
    return cosines_sql(asking) + f""",
    allowed AS (SELECT q.mal_id AS q, c.mal_id AS c, c.slot, coalesce(t.cosine, 0) AS t, coalesce(k.cosine, 0) AS k,
        q.mal_id IN (SELECT mal_id FROM v) AND c.mal_id IN (SELECT mal_id FROM v) AS both_text
      FROM {asked_of('p', asking)} q JOIN p c ON c.eligible AND q.mal_id <> c.mal_id {rule}
      LEFT JOIN text_pairs t ON t.q = q.mal_id AND t.c = c.mal_id LEFT JOIN tag_pairs k ON k.q = q.mal_id AND k.c = c.mal_id),
    ranked AS (SELECT *, {share('t')} AS tp, {share('k')} AS kp FROM allowed WINDOW q AS (PARTITION BY q)),
    blended AS (SELECT *, CAST(0.7::DOUBLE * CASE WHEN both_text THEN tp ELSE 0 END + 0.3::DOUBLE * kp AS FLOAT) AS s FROM ranked WHERE t + k > 0),
    pool AS (SELECT * FROM blended QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, c) <= {50 if skip_series else 10}),
    firsts AS (SELECT * FROM pool {"QUALIFY row_number() OVER (PARTITION BY q, slot ORDER BY s DESC, c) = 1" if skip_series else ""}),
    picks AS (SELECT q AS anime_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS rank, c AS similar_id, s, t, k FROM firsts
      QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, c) <= 10)"""


def profiles(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return once(spark, folder, "profiles", lambda: R.profiles(X.docs(spark, folder), X.doc_links(spark, folder)))


def picks(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return once(spark, folder, "picks", lambda: settle(R.top_k(profiles(spark, folder)), "picks"))


def term_counts(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return V.term_counts(X.docs(spark, folder))


def listed(recs: DataFrame) -> DataFrame:
    return recs.select("anime_id", "rank", "similar_id", F.round(F.col("similarity").cast("double"), 4).alias("similarity"))


SCORE = "round_even(CAST(s AS DOUBLE), 4)"
LISTED = f"anime_id, rank, similar_id, {SCORE} AS similarity"

check(
    "title_key",
    lambda s, d: X.docs(s, d).select(
        "mal_id", F.array_join(K.title_words(F.col("title")), " ").alias("words"), K.series_key(F.col("title")).alias("key"),
        K.first_word(F.col("title")).alias("one"), K.two_words(F.col("title")).alias("two"), K.key_size(F.col("title")).alias("size"),
    ),
    f"{DOCS} SELECT mal_id, array_to_string(d.words, ' ') AS words, key, one, two, CAST(size AS INTEGER) AS size FROM p JOIN d USING (mal_id)",
)
check(
    "rec_eligible",
    lambda s, d: X.docs(s, d).select("mal_id", M.watched().alias("eligible")),
    f"{DOCS} SELECT mal_id, eligible FROM p",
)
check(
    "rec_clean_text",
    lambda s, d: X.docs(s, d).agg(
        F.count("*").alias("titles"),
        F.count_if(V.usable_text(F.col("synopsis")).isNull()).alias("without_text"),
        F.count_if(V.is_placeholder(F.col("synopsis"))).alias("placeholders"),
        F.sum(F.length(V.usable_text(F.col("synopsis")))).alias("characters"),
    ),
    rf"""{DOCS} SELECT count(*) AS titles, count(*) FILTER (words_from IS NULL) AS without_text,
    count(*) FILTER (regexp_matches(synopsis, '(?i)^\s*no synopsis (information )?has been added')) AS placeholders,
    CAST(sum(length(words_from)) AS BIGINT) AS characters FROM p JOIN docs USING (mal_id)""",
)
check(
    "rec_tags",
    lambda s, d: R.usable_links(X.tables(s, d)),
    f"""{BASE} SELECT anime_id AS mal_id, name AS tag, kind FROM title_tags JOIN tags USING (genre_id)
    WHERE kind IN ('genre', 'theme', 'demographic') AND name <> 'Award Winning'""",
)
check(
    "rec_tag_vectors",
    lambda s, d: V.tag_vectors(V.tag_sets(R.usable_tags(X.doc_links(s, d)))).withColumn("weight", F.round("weight", 9)),
    f"{TEXT} SELECT mal_id, tag, round(w, 9) AS weight FROM g",
)
check(
    "rec_vocabulary",
    lambda s, d: V.vocabulary(term_counts(s, d), X.read(s, d, "documents").count()).select("term", "df", F.round("idf", 9).alias("idf")),
    f"{TEXT} SELECT term, df, round(ln((1 + (SELECT count(*) FROM p)) / (1 + df)) + 1, 9) AS idf FROM vocab",
)


def _tfidf(spark, folder: str) -> DataFrame:  # noqa: ANN001
    counts = settle(term_counts(spark, folder), "terms")
    vocab = V.vocabulary(counts, X.read(spark, folder, "documents").count())
    long = V.unpack_text(V.text_vectors(counts, vocab))
    return long.join(F.broadcast(vocab.select("term_id", "term")), "term_id").select("mal_id", "term", F.round("weight", 9).alias("weight"))


check("rec_tfidf", _tfidf, f"{TEXT} SELECT mal_id, term, round(w, 9) AS weight FROM v")
check(
    "rec_series_hidden",
    lambda s, d: R.series_sizes(profiles(s, d)),
    f"{DOCS} SELECT q.mal_id, count(c.mal_id) AS hidden FROM p q LEFT JOIN p c ON c.eligible AND c.mal_id <> q.mal_id AND {SERIES} GROUP BY q.mal_id",
)
check(
    "rec_topk",
    lambda s, d: listed(R.top_k(R.profiles(X.docs(s, d), X.doc_links(s, d)))),
    f"{blend_sql(True)} SELECT {LISTED} FROM picks",
)
check(
    "rec_topk_no_franchise",
    lambda s, d: listed(R.top_k(profiles(s, d), skip_series=False)),
    f"{blend_sql(False)} SELECT {LISTED} FROM picks",
)
check(
    "rec_topk_blocks",
    # At least three candidate blocks, whatever the size.
    lambda s, d: listed(R.top_k(profiles(s, d), candidate_block=profiles(s, d).where("eligible").count() // 3 + 1)),
    f"{blend_sql(True)} SELECT {LISTED} FROM picks",
)
check(
    "rec_one_per_key",
    lambda s, d: R.one_per_slot(
        X.docs(s, d).select(F.col("lang").alias("anime_id"), F.col("mal_id").alias("similar_id"), "source", F.col("n_chars").alias("score"))
        .withColumn("slot", F.col("source")), 5
    ).select("anime_id", "similar_id", "slot", "rank"),
    """SELECT lang AS anime_id, doc_id AS similar_id, source AS slot, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank
    FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 5""",
)
check(
    "rec_pair_cosines",
    lambda s, d: R.pair_cosines(picks(s, d), profiles(s, d)).select(
        "anime_id", "similar_id", F.round(F.round("text_cosine", 9), 6).alias("text_cosine"), F.round(F.round("tag_cosine", 9), 6).alias("tag_cosine")
    ),
    f"{blend_sql(True)} SELECT anime_id, similar_id, round(t, 6) AS text_cosine, round(k, 6) AS tag_cosine FROM picks",
)
OVERLAP_SQL = """sets AS (SELECT mal_id, list(DISTINCT tag) AS tags FROM doc_links WHERE kind = 'genre' AND tag <> 'Award Winning' GROUP BY mal_id),
overlap AS (SELECT avg(CAST(coalesce(list_has_any(a.tags, b.tags), FALSE) AS INTEGER)) AS share FROM picks JOIN sets a ON a.mal_id = anime_id LEFT JOIN sets b ON b.mal_id = similar_id)"""
check(
    "rec_eval_overlap",
    lambda s, d: R.tag_overlap(picks(s, d), R.usable_tags(X.doc_links(s, d)).where("kind = 'genre'")).select(F.round("tag_overlap_at_10", 6).alias("overlap")),
    f"{blend_sql(True)}, {OVERLAP_SQL} SELECT round(share, 6) AS overlap FROM overlap",
)
check(
    "rec_eval",
    lambda s, d: R.evaluation(profiles(s, d), picks(s, d), X.doc_links(s, d)),
    f"""{blend_sql(True)}, {OVERLAP_SQL}, lists AS (SELECT p.mal_id, count(anime_id) AS n FROM p LEFT JOIN picks ON anime_id = p.mal_id GROUP BY p.mal_id)
    SELECT (SELECT count(*) FROM p) AS titles, (SELECT count(*) FROM p WHERE eligible) AS recommendable_titles,
      (SELECT count(*) FROM p WHERE words_from IS NULL) AS titles_without_synopsis,
      (SELECT count(*) FROM docs WHERE regexp_matches(synopsis, '(?i)^\\s*no synopsis (information )?has been added')) AS placeholder_synopses,
      (SELECT count(*) FROM vocab) AS text_features, (SELECT count(DISTINCT tag) FROM g) AS tag_features,
      (SELECT count(*) FROM picks) AS recommendation_rows, (SELECT count(*) FROM lists WHERE n < 10) AS titles_with_fewer_than_k,
      (SELECT round(share, 4) FROM overlap) AS tag_overlap_at_10,
      (SELECT round(count(DISTINCT similar_id) / (SELECT count(*) FROM p WHERE eligible), 4) FROM picks) AS coverage_of_recommendable,
      (SELECT round(count(DISTINCT similar_id) / (SELECT count(*) FROM p), 4) FROM picks) AS coverage_of_all_titles,
      (SELECT round(median(t), 3) FROM picks) AS median_text_cosine, (SELECT round(median(k), 3) FROM picks) AS median_tag_cosine""",
)


def _spot_ids(spark, folder: str) -> list[int]:  # noqa: ANN001
    """The five longest documents, as the titles to read by eye."""
    rows = X.read(spark, folder, "documents").orderBy(F.desc("n_chars"), "doc_id").select("doc_id").limit(5).collect()
    return [r.doc_id for r in rows]


for _name, _skip in (("rec_spot_checks", True), ("rec_spot_checks_no_franchise", False)):
    check(
        _name,
        lambda s, d, skip=_skip: R.spot_checks(
            R.top_k(profiles(s, d), query_ids=_spot_ids(s, d), skip_series=skip), X.docs(s, d), _spot_ids(s, d)
        ).withColumn("picks", F.concat_ws("|", "picks")),
        f"""{blend_sql(_skip, f"mal_id IN {SPOT_IDS}")} SELECT q.mal_id, q.title, coalesce(string_agg(c.title, '|' ORDER BY rank), '') AS picks
        FROM p q SEMI JOIN asking USING (mal_id) LEFT JOIN picks ON anime_id = q.mal_id AND rank <= 5 LEFT JOIN p c ON c.mal_id = similar_id GROUP BY ALL""",
    )


# -- lookups --------------------------------------------------------------------------------------
def catalog(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return once(spark, folder, "catalog", lambda: settle(M.catalog(X.titles(spark, folder), X.tables(spark, folder)), "catalog"))


def doc_catalog(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """The documents in the catalog's shape."""
    tags = V.tag_sets(X.doc_links(spark, folder))
    none = F.array().cast("array<string>")
    rows = X.docs(spark, folder).join(tags, "mal_id", "left").withColumn("genres", F.coalesce("tags", none))
    return rows.select("mal_id", "title", "title_english", "type", "year", "score", "members", "genres", none.alias("studios"))


def texts(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.concat_ws("|", c) for c in ("genres", "studios") if c in df.columns})


CATALOG = f"""{BASE}, catalog AS (SELECT mal_id, title, title_english, type, year, CAST(score AS DOUBLE) AS score, members,
  (SELECT coalesce(list(name ORDER BY name), []) FROM title_tags JOIN tags USING (genre_id) WHERE anime_id = t.mal_id) AS genres,
  (SELECT coalesce(list(name ORDER BY name), []) FROM title_companies JOIN companies c USING (company_id) WHERE anime_id = t.mal_id AND role = 'studio') AS studios FROM titles t)"""
SUMMARY = ", ".join(L.SUMMARY)
DOC_CATALOG = "doc_tags AS (SELECT mal_id, list(DISTINCT tag ORDER BY tag) AS genres FROM doc_links GROUP BY mal_id)"
BUSIEST = "(SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)"


def _busiest(spark, folder: str) -> int:  # noqa: ANN001
    return X.read(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").first().o_orderkey


check(
    "serve_find",
    lambda s, d: texts(L.find(catalog(s, d), _busiest(s, d))),
    f"{CATALOG} SELECT * REPLACE (array_to_string(genres, '|') AS genres, array_to_string(studios, '|') AS studios) FROM catalog WHERE mal_id = {BUSIEST}",
)
check(
    "serve_search",
    lambda s, d: L.search(catalog(s, d), "MACHINERY (199", 20),
    f"""{CATALOG} SELECT {SUMMARY} FROM catalog WHERE contains(lower(title), 'machinery (199') OR contains(lower(title_english), 'machinery (199')
    ORDER BY members DESC NULLS LAST, mal_id LIMIT 20""",
)
# Queries of a batch: every segment with every year in brackets, and the (one-letter) states of orders.
SEARCHES = """SELECT DISTINCT c_mktsegment || ' (' || CAST(year(o_orderdate) AS STRING) || ')' AS query FROM orders JOIN customer ON c_custkey = o_custkey
  UNION SELECT o_orderstatus FROM orders UNION SELECT substring(c_name, 12, 5) FROM customer"""


def _searches(spark, folder: str) -> DataFrame:  # noqa: ANN001
    for name in ("orders", "customer"):
        X.read(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(SEARCHES).select(F.col("query").alias("query_id"), "query")


check(
    "serve_search_batch",
    lambda s, d: L.search_many(catalog(s, d), _searches(s, d), 5),
    f"""{CATALOG}, q AS ({SEARCHES.replace("STRING", "VARCHAR")}),
    hits AS (SELECT q.query AS query_id, row_number() OVER (PARTITION BY q.query ORDER BY members DESC NULLS LAST, mal_id) AS rank, {SUMMARY}
      FROM q JOIN catalog ON contains(lower(title), lower(query)) OR coalesce(contains(lower(title_english), lower(query)), false))
    SELECT * FROM hits WHERE rank <= 5""",
)
RECS = blend_sql(True) + f", {DOC_CATALOG}"
PICKED = "SELECT mal_id FROM docs WHERE mal_id IN (SELECT anime_id FROM picks) ORDER BY n_chars DESC, mal_id LIMIT 1"


def _picked(spark, folder: str) -> int:  # noqa: ANN001
    known = picks(spark, folder).select(F.col("anime_id").alias("mal_id")).distinct()
    return X.docs(spark, folder).join(known, "mal_id").orderBy(F.desc("n_chars"), "mal_id").first().mal_id


check(
    "serve_recommend",
    lambda s, d: L.recommend(doc_catalog(s, d), R.recommendations(picks(s, d)), _picked(s, d), 7),
    f"""{RECS} SELECT anime_id, rank, {SCORE} AS match_score, {SUMMARY.replace('mal_id', 'docs.mal_id')}
    FROM picks JOIN docs ON docs.mal_id = similar_id WHERE anime_id = ({PICKED}) AND rank <= 7""",
)
check(
    "serve_shared_tags",
    lambda s, d: L.picks_table(doc_catalog(s, d), R.recommendations(picks(s, d)))
    .withColumn("shared", F.concat_ws("|", "shared")),
    f"""{RECS} SELECT anime_id, rank, similar_id, title || ' (' || type || CASE WHEN year IS NULL THEN '' ELSE ', ' || year END || ')' AS label,
      {SCORE} AS match_score, score,
      array_to_string(list_sort(list_intersect(coalesce(a.genres, []), coalesce(b.genres, []))), '|') AS shared
    FROM picks JOIN docs ON docs.mal_id = similar_id LEFT JOIN doc_tags a ON a.mal_id = anime_id LEFT JOIN doc_tags b ON b.mal_id = similar_id""",
)
check(
    "serve_title_label",
    lambda s, d: X.titles(s, d).select("mal_id", K.title_label(F.col("title"), F.col("type"), F.col("year")).alias("label")),
    f"""WITH {X.TITLES_SQL}, y AS (SELECT *, CASE WHEN NOT contains(title, '(' || year || ')') THEN CAST(year AS STRING) END AS shown FROM titles)
    SELECT mal_id, title || CASE WHEN concat_ws(', ', type, shown) <> '' THEN ' (' || concat_ws(', ', type, shown) || ')' ELSE '' END AS label FROM y""",
)


def _stored_lookup(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """Picks written for lookups and opened again with the other served tables."""
    root = working_path(spark, "served")
    S.write_table(doc_catalog(spark, folder), root, "catalog")
    S.write_lookup(R.recommendations(picks(spark, folder)), root, "recommendations", "anime_id", ["anime_id", "rank"])
    S.write_facts(X.titles(spark, folder).agg(F.max("updated_at").alias("data_last_updated")), root, "metadata")
    served = S.load_tables(spark, root, ["catalog", "recommendations"], "metadata")
    return listed(served["recommendations"])


check("sink_tables", _stored_lookup, f"{RECS} SELECT {LISTED} FROM picks")
FILTER = dict(types=["BUILDING", "MACHINERY"], years=(1996, 1998), genre="STANDARD", studio="Supplier#000000007", min_members=2000)
check(
    "catalog_filter",
    lambda s, d: texts(L.filter_catalog(catalog(s, d), **FILTER)),
    f"""{CATALOG} SELECT * REPLACE (array_to_string(genres, '|') AS genres, array_to_string(studios, '|') AS studios) FROM catalog
    WHERE type IN ('BUILDING', 'MACHINERY') AND year BETWEEN 1996 AND 1998 AND list_contains(genres, 'STANDARD')
    AND list_contains(studios, 'Supplier#000000007') AND members >= 2000""",
)
check(
    "catalog_explore",
    lambda s, d: L.explore(L.filter_catalog(catalog(s, d), types=["FURNITURE"], min_members=1000)),
    f"""{CATALOG} SELECT * EXCLUDE (mal_id) REPLACE (array_to_string(genres, ', ') AS genres, array_to_string(studios, ', ') AS studios) FROM catalog
    WHERE type = 'FURNITURE' AND members >= 1000""",
)
check(
    "catalog_options",
    lambda s, d: L.list_options(catalog(s, d), "genres").unionByName(L.list_options(catalog(s, d), "studios")),
    f"{CATALOG} SELECT DISTINCT unnest(genres) AS option FROM catalog UNION ALL SELECT DISTINCT unnest(studios) FROM catalog",
)
HISTOGRAM = """ends AS (SELECT CAST(floor(min(score) / 0.25) AS BIGINT) AS low, CAST(ceil(max(score) / 0.25) AS BIGINT) AS high FROM scored),
bins AS (SELECT unnest(range(low, high + 1)) AS b FROM ends),
histogram AS (SELECT b * 0.25 AS bin_start, printf('%.2f-%.2f', CAST(b * 0.25 AS DOUBLE), CAST((b + 1) * 0.25 AS DOUBLE)) AS label, count(score) AS count
  FROM bins LEFT JOIN scored ON floor(score / 0.25) = b GROUP BY b)"""
SCORED = f"WITH {X.TITLES_SQL}, scored AS (SELECT CAST(score AS DOUBLE) AS score FROM titles WHERE score IS NOT NULL AND members >= 1000)"


def _scored(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return X.titles(spark, folder).where(M.watched()).select(F.col("score").cast("double").alias("score"))


check(
    "score_histogram",
    lambda s, d: L.score_histogram(_scored(s, d)),
    f"{SCORED}, {HISTOGRAM} SELECT CAST(bin_start AS DOUBLE) AS bin_start, label, count FROM histogram",
)
check(
    "score_median_bin",
    lambda s, d: L.bin_label_for(L.score_histogram(_scored(s, d)), _scored(s, d).agg(F.median("score")).first()[0]),
    f"{SCORED}, {HISTOGRAM} SELECT label FROM histogram WHERE bin_start <= (SELECT median(score) FROM scored) ORDER BY bin_start DESC LIMIT 1",
)
check(
    "overview_kpis",
    lambda s, d: L.overview(catalog(s, d), R.recommendations(picks(s, d))),
    f"""{blend_sql(True)}, {X.TITLES_SQL}, scored AS (SELECT CAST(score AS DOUBLE) AS score FROM titles WHERE score IS NOT NULL AND members >= 1000)
    SELECT (SELECT count(*) FROM titles) AS titles, count(*) AS scored_titles, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median,
      quantile_cont(score, 0.75) AS q3, (SELECT count(DISTINCT anime_id) FROM picks) AS titles_with_recommendations FROM scored""",
)
check(
    "serve_json",
    lambda s, d: L.as_json(X.titles(s, d).select("mal_id", "title", "title_english", "type", "members")),
    f"""WITH {X.TITLES_SQL} SELECT '{{"mal_id":' || mal_id || ',"title":"' || title || '","title_english":' || coalesce('"' || title_english || '"', 'null') ||
    ',"type":' || coalesce('"' || type || '"', 'null') || ',"members":' || coalesce(CAST(members AS STRING), 'null') || '}}' AS json FROM titles""",
)
