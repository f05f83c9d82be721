"""Picks on an invented catalog of three topics, and tiles against brute force."""

import numpy as np
import pandas as pd
import pytest

import checks.recommend  # noqa: F401
from checks.registry import QUERIES
from titleworks.operators import text_vectors as V
from titleworks.operators import tiles
from titleworks.operators.tiles import best_pairs, percentiles
from titleworks.plans import lookup as L
from titleworks.plans import recommender as R

TOPICS = {
    "volcano": "lava ash crater glow basalt tremor plume ridge",
    "bakery": "flour oven crust yeast dough butter rye glaze",
    "submarine": "hull sonar ballast trench torpedo periscope brine dive",
}
TAGS = {"volcano": ["Nature", "Peril"], "bakery": ["Food"], "submarine": ["Peril", "Water"]}


def invented():
    """Three topics with five titles each: a trilogy of one series, a title of its own, and one that is not scored."""
    rows, links = [], []
    for t, (topic, words) in enumerate(TOPICS.items()):
        words = words.split()
        for k in range(5):
            number = 10 * t + k
            name = f"The {topic.title()} Tales {'I' * (k + 1)}" if k < 3 else f"{words[k].title()} {words[k + 1].title()} {topic.title()}"
            text = " ".join(words[:6] + words[k : k + 3] * 2 + [f"only{number}"])
            rows.append((number, name, text, None if k == 4 else 6.0 + 0.25 * k + 0.5 * t, 2_000 + 100 * number))
            links += [(number, tag) for tag in TAGS[topic]]
    rows.append((90, "Blank", "  ", 5.5, 1_500))
    links += [(90, "Water"), (0, "Award Winning"), (11, "Award Winning")]
    return rows, links


TITLES, LINKS = invented()


@pytest.fixture(scope="module")
def titles(spark):
    return spark.createDataFrame(TITLES, "mal_id bigint, title string, synopsis string, score double, members bigint")


@pytest.fixture(scope="module")
def links(spark):
    rows = [(i, t, "genre") for i, t in LINKS] + [(13, "Gore", "explicit_genre")]
    return spark.createDataFrame(rows, "mal_id bigint, tag string, kind string")


@pytest.fixture(scope="module")
def rows(titles, links):
    return R.profiles(titles, links)


@pytest.fixture(scope="module")
def picks(rows):
    return R.top_k(rows).cache()


def listed(recs):
    pdf = recs.toPandas().sort_values(["anime_id", "rank"])
    return pdf.groupby("anime_id").similar_id.apply(list).to_dict()


def topic_of(number):
    return number // 10


def test_lists_keep_to_the_rules(picks):
    found = listed(picks)
    unscored = {i for i, *_, score, _ in TITLES if score is None}
    for number, ids in found.items():
        assert number not in ids and not unscored & set(ids)
        series = [topic_of(i) for i in ids if i != 90 and i % 10 < 3]
        assert len(series) == len(set(series))  # one title of a series
        if number % 10 < 3 and number != 90:
            assert topic_of(number) not in series  # and none of its own
    assert all(found[i] for i in unscored)
    for t in range(3):  # a trilogy's title is followed by the other title of its topic
        assert found[10 * t][0] == 10 * t + 3
    blank = picks.where("similar_id = 90").toPandas()
    assert len(blank) and (blank.similarity <= 0.3 + 1e-6).all() and (blank.text_cosine == 0).all()


def test_shorter_lists_are_the_beginnings_of_longer_ones(rows, picks):
    whole = listed(picks)
    assert listed(R.top_k(rows, k=3)) == {i: ids[:3] for i, ids in whole.items()}
    asked = listed(R.top_k(rows, k=3, query_ids=[4, 90]))
    assert asked == {i: whole[i][:3] for i in (4, 90)}


def test_the_series_rule_can_be_left_out(rows):
    own = listed(R.top_k(rows, k=1, skip_series=False))
    assert all(topic_of(own[10 * t + k][0]) == t for t in range(3) for k in range(3))
    assert any(own[i][0] % 10 < 3 and i % 10 < 3 for i in (0, 1, 2))


def test_tags_and_texts_that_do_not_count(spark, links, titles):
    kept = {r.tag for r in R.usable_tags(links).collect()}
    assert not kept & {"Award Winning", "Gore"}
    texts = ["", "   ", None, "No synopsis has been added for this series yet.\n\nClick here.", "no synopsis information has been added to this title.", "Real text"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(V.usable_text(V.F.col("s"))).collect()] == [None] * 5 + ["Real text"]
    assert df.where(V.is_placeholder(V.F.col("s"))).count() == 2


def test_words_of_any_script_and_pairs(spark):
    df = spark.createDataFrame([("The Déjà_vu is a cat; ÉTÉ cat-dog 42 x",)], "t string")
    words = df.select(V.word_list(V.F.col("t")).alias("w"))
    assert words.first().w == ["déjà_vu", "cat", "été", "cat", "dog", "42"]
    assert words.select(V.with_pairs(V.F.col("w"))).first()[0][6:] == ["déjà_vu cat", "cat été", "été cat", "cat dog", "dog 42"]


def test_vectors_have_length_one_and_the_vocabulary_is_limited(titles):
    counts = V.term_counts(titles).cache()
    vocab = V.vocabulary(counts, len(TITLES), max_terms=9)
    used = counts.groupBy("term").agg(V.F.sum("tf").alias("cf"), V.F.count("*").alias("df")).where("df > 1").toPandas()
    assert {r.term for r in vocab.collect()} == set(used.sort_values(["cf", "term"], ascending=[False, True]).term[:9])
    vectors = V.text_vectors(counts, vocab).toPandas()
    assert all(np.linalg.norm(w) == pytest.approx(1) for w in vectors.weights) and 90 not in set(vectors.mal_id)


def test_cosines_of_pairs_match_the_tiles(picks, rows):
    a = picks.toPandas().set_index(["anime_id", "similar_id"]).sort_index()
    b = R.pair_cosines(picks, rows).toPandas().set_index(["anime_id", "similar_id"]).sort_index()
    np.testing.assert_allclose(a.text_cosine, b.text_cosine, atol=1e-8)
    np.testing.assert_allclose(a.tag_cosine, b.tag_cosine, atol=1e-8)


def test_percentiles_are_shares_of_ranks():
    rng = np.random.default_rng(77)
    scores, allowed = np.round(rng.random((40, 30)), 1), rng.random((40, 30)) < 0.8
    scores[7], allowed[8] = 0.4, False
    found = percentiles(scores, allowed)
    for row, keep, got in zip(scores, allowed, found, strict=True):
        ranks = pd.Series(row[keep]).rank()
        flat = ranks.nunique() < 2
        assert got[keep] == pytest.approx(0 * ranks if flat else (ranks - 1) / (len(ranks) - 1)) and not got[~keep].any()


def brute_force(pdf, pool, skip):
    """Every pair, dense, straight from the definition."""
    candidates = pdf[pdf.eligible].reset_index(drop=True)
    vec = [dict(zip(i, w)) if i is not None else {} for i, w in zip(pdf.term_ids, pdf.weights)]
    cvec = [dict(zip(i, w)) if i is not None else {} for i, w in zip(candidates.term_ids, candidates.weights)]
    out = {}
    for q in range(len(pdf)):
        rows = []
        for c in range(len(candidates)):
            me, it = pdf.iloc[q], candidates.iloc[c]
            hidden = me.series_rule is not None and me.series_rule in list(it.series_codes)
            if me.mal_id == it.mal_id or (skip and hidden):
                continue
            text = round(sum(w * cvec[c].get(t, 0) for t, w in vec[q].items()), 9)
            a, b = set(me.tags if me.tags is not None else []), set(it.tags if it.tags is not None else [])
            tag = round(len(a & b) / np.sqrt(len(a) * len(b)), 9) if a and b else 0.0
            rows.append((int(it.mal_id), text, tag, bool(vec[q]) and bool(cvec[c])))
        table = pd.DataFrame(rows, columns=["c", "text", "tag", "both"])
        share = lambda s: (s.rank() - 1) / max(len(s) - 1, 1) if s.nunique() > 1 else s * 0.0
        table["score"] = (0.7 * np.where(table.both, share(table.text), 0) + 0.3 * share(table.tag)).astype("f4")
        table = table[table.text + table.tag > 0].sort_values(["score", "c"], ascending=[False, True]).head(pool)
        out[int(pdf.mal_id[q])] = [(c, round(float(s), 5)) for c, s in zip(table.c, table.score)]
    return {q: picks for q, picks in out.items() if picks}


@pytest.fixture(scope="module")
def random_profiles(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(140):
        terms = np.unique(np.r_[rng.integers(0, 60, rng.integers(0, 9)), [0, 1][: rng.integers(0, 3)]]).astype(int)
        weights = rng.random(len(terms)) + 0.1
        weights /= np.linalg.norm(weights) if len(weights) else 1
        tags = sorted({f"t{t}" for t in rng.integers(0, 4, rng.integers(0, 4))})
        size = int(rng.integers(0, 3))
        first, second = f"w{rng.integers(0, 25)}", f"v{rng.integers(0, 3)}"
        codes = [f"1:{first}", f"2:{first} {second}"][:size]
        rows.append((
            i, [int(t) for t in terms] or None, [float(w) for w in weights] or None, tags or None, codes[-1] if codes else None,
            codes, f"s{i}", bool(rng.random() < 0.7),
        ))
    # Some exact copies, so that ties cross block borders.
    rows += [(200 + i, *rows[i][1:]) for i in range(20)]
    schema = "mal_id bigint, term_ids array<int>, weights array<double>, tags array<string>, series_rule string, series_codes array<string>, slot string, eligible boolean"
    return spark.createDataFrame(rows, schema).cache()


@pytest.mark.parametrize("skip", [True, False])
@pytest.mark.parametrize("blocks", [(1000, 1000), (50, 1000), (70, 17), (1000, 40)])
def test_tiles_equal_brute_force(random_profiles, skip, blocks):
    expected = brute_force(random_profiles.toPandas(), 7, skip)
    pairs = best_pairs(random_profiles, random_profiles.where("eligible"), 7, skip, *blocks).toPandas()
    pairs = pairs.sort_values(["anime_id", "score", "similar_id"], ascending=[True, False, True])
    found = {int(q): [(int(c), round(float(s), 5)) for c, s in zip(g.similar_id, g.score)] for q, g in pairs.groupby("anime_id")}
    assert found == expected


@pytest.mark.parametrize("blocks", [(30, 1000), (30, 40)])
def test_several_query_blocks_share_a_task(random_profiles, monkeypatch, blocks):
    """Candidates go to groups of query blocks and not to each block; a part of the titles may ask."""
    monkeypatch.setattr(tiles, "LEAST_TASKS", 1)
    assert tiles._blocks(160, 112, *blocks)[0] == 1
    expected = {q: found for q, found in brute_force(random_profiles.toPandas(), 7, True).items() if q % 3 == 0}
    pairs = best_pairs(random_profiles.where("mal_id % 3 = 0"), random_profiles.where("eligible"), 7, True, *blocks).toPandas()
    pairs = pairs.sort_values(["anime_id", "score", "similar_id"], ascending=[True, False, True])
    assert {int(q): [(int(c), round(float(s), 5)) for c, s in zip(g.similar_id, g.score)] for q, g in pairs.groupby("anime_id")} == expected
    asked = R.top_k(random_profiles, 3, asking=V.F.expr("mal_id % 3 = 0")).select("anime_id").distinct().collect()
    assert {r.anime_id for r in asked} == set(expected)


def test_candidates_are_sent_to_few_groups_of_queries():
    assert tiles._blocks(5_000, 300_000, 320, 16_384) == (4, 19)
    assert tiles._blocks(500_000, 300_000, 320, 16_384) == (49, 19)
    assert tiles._blocks(1_000, 600, 320, 16_384) == (4, 1)


def test_of_each_slot_the_best_stays(spark):
    rng = np.random.default_rng(8)
    rows = [(q, c, f"s{rng.integers(0, 6)}", float(x)) for q in range(5) for c, x in enumerate(rng.permutation(20) / 20)]
    kept = R.one_per_slot(spark.createDataFrame(rows, "anime_id bigint, similar_id bigint, slot string, score double"), 4).collect()
    for q in range(5):
        best = {}
        for _, c, slot, x in sorted((r for r in rows if r[0] == q), key=lambda r: -r[3]):
            best.setdefault(slot, c)
        assert [r.similar_id for r in sorted((r for r in kept if r.anime_id == q), key=lambda r: r["rank"])] == list(best.values())[:4]


def test_many_equal_candidates_leave_a_tile_as_few_rows(spark):
    """Titles without text that share their only tag tie; each block keeps a pool of them."""
    schema = "mal_id bigint, term_ids array<int>, weights array<double>, tags array<string>, series_rule string, series_codes array<string>, slot string, eligible boolean"
    rows = [(i, None, None, ["same" if i % 5 else f"t{i}"], None, [], f"s{i}", True) for i in range(1250)]
    df = spark.createDataFrame(rows, schema)
    found = best_pairs(df.where("mal_id < 20"), df, 7, True, 1000, 500).toPandas()
    for q in range(20):
        ids = found[found.anime_id == q].sort_values(["score", "similar_id"], ascending=[False, True]).similar_id.tolist()
        assert ids == ([i for i in range(30) if i % 5 and i != q][:7] if q % 5 else [])


def test_series_sizes_equal_the_pair_rule(rows):
    found = {r.mal_id: r.hidden for r in R.series_sizes(rows).collect()}
    assert found == {i: 2 if i % 10 < 3 and i < 90 else 0 for i, *_ in TITLES}


def test_evaluation(spark, rows, picks, links, titles):
    recs = spark.createDataFrame([(5, 1, 6), (5, 2, 7), (5, 3, 8), (6, 1, 9)], "anime_id bigint, rank int, similar_id bigint")
    kinds = {5: "ab", 6: "b", 7: "c", 8: "ca", 9: "d"}
    tags = spark.createDataFrame([(i, t) for i, ts in kinds.items() for t in ts], "mal_id bigint, tag string")
    # Of the four picks 6 and 8 share a tag with 5; 7 and 9 share none.
    assert R.tag_overlap(recs, tags).first()[0] == pytest.approx(2 / 4)
    facts = R.evaluation(rows, picks, links).first()
    listed_ids = {i for ids in listed(picks).values() for i in ids}
    assert (facts.titles, facts.recommendable_titles, facts.titles_without_synopsis, facts.tag_features) == (16, 13, 1, 4)
    assert facts.coverage_of_all_titles == pytest.approx(len(listed_ids) / 16, abs=1e-4)
    assert facts.titles_with_fewer_than_k == 16
    spot = {r.mal_id: r.picks for r in R.spot_checks(picks, titles, [10, 1234]).collect()}
    assert list(spot) == [10] and spot[10][0] == TITLES[8][1]


def test_lookups(spark, picks, links, titles):
    none = V.F.array().cast("array<string>")
    catalog = (
        titles.join(V.tag_sets(links), "mal_id", "left")
        .selectExpr("mal_id", "title", "CASE WHEN mal_id = 21 THEN 'Below [the] Sea' END AS title_english", "'Movie' AS type", "1990 + mal_id AS year", "score", "members", "tags")
        .withColumn("genres", V.F.coalesce("tags", none)).withColumn("studios", none).drop("tags")
    )
    recs = R.recommendations(picks)
    assert {r.mal_id for r in L.search(catalog, "vOLCano t", 10).collect()} == {0, 1, 2}
    assert [r.mal_id for r in L.search(catalog, "[the]", 10).collect()] == [21]
    with pytest.raises(ValueError):
        L.search(catalog, "x", 51)
    first = L.recommend(catalog, recs, 12, 2).collect()
    assert [r["rank"] for r in first] == [1, 2][: len(first)] and first[0].title == TITLES[8][1]
    with pytest.raises(L.UnknownTitle):
        L.recommend(catalog, recs, 77)
    table = L.picks_table(catalog, recs.where("anime_id = 12")).orderBy("rank").first()
    assert (table.label, table.shared) == (f"{TITLES[8][1]} (Movie, 2003)", ["Food"])
    assert L.filter_catalog(catalog, genre="Peril", years=(1991, 2010)).count() == 5
    assert L.filter_catalog(catalog).count() == 16 and L.filter_catalog(catalog, min_members=4_200).count() == 3
    assert [r.option for r in L.list_options(catalog, "genres").collect()] == ["Award Winning", "Food", "Gore", "Nature", "Peril", "Water"]
    assert {r.title for r in L.explore(catalog).collect()} <= {title for _, title, *_ in TITLES}
    assert '"title_english":null' in L.as_json(catalog.where("mal_id = 2")).first()[0]
    facts = L.overview(catalog, recs).first()
    assert (facts.titles, facts.scored_titles) == (16, 13)


def test_histogram(spark):
    scores = spark.createDataFrame([(s,) for s in (6.5, 6.74, 6.75, 7.3, None)], "score double")
    bins = L.score_histogram(scores)
    assert [(r.label, r["count"]) for r in bins.collect()] == [("6.50-6.75", 2), ("6.75-7.00", 1), ("7.00-7.25", 0), ("7.25-7.50", 1), ("7.50-7.75", 0)]
    assert L.bin_label_for(bins, 6.75).first().label == "6.75-7.00"
    assert L.bin_label_for(bins, 1.0).first().label == "6.50-6.75"
    assert L.score_histogram(scores.where("score > 9")).count() == 0


@pytest.fixture(scope="module")
def tables_of_documents(spark, tmp_path_factory):
    """Forty short documents, none with an id divisible by 100; half of them may be picked."""
    folder = str(tmp_path_factory.mktemp("documents"))
    words = "amber birch cedar delta ember frost grove heath inlet juniper".split()
    texts = [" ".join(words[(i + j * j) % 10] for j in range(6)) for i in range(40)]
    docs = [(i + 1, text, "en" if i % 3 else "fi", f"s{i % 4}", 400 + i) for i, text in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(i + 1, i % 2, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    one = {
        "customer": "1 AS c_custkey, 'Ann' AS c_name, 'TOYS' AS c_mktsegment",
        "orders": "5 AS o_orderkey, 1 AS o_custkey, 900D AS o_totalprice, DATE'1996-01-02' AS o_orderdate, 'F' AS o_orderstatus, 'LOW' AS o_orderpriority",
        "part": "1 AS p_partkey, 'SMALL' AS p_type, 'Brand#1' AS p_brand, 3 AS p_size",
        "lineitem": "5 AS l_orderkey, 1 AS l_partkey, 1 AS l_suppkey, 'A' AS l_returnflag",
        "supplier": "1 AS s_suppkey, 'Sun' AS s_name",
    }
    for name, row in one.items():
        spark.sql(f"SELECT {row}").write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["rec_topk", "rec_topk_no_franchise", "rec_topk_blocks", "rec_pair_cosines", "serve_shared_tags", "sink_tables"])
def test_every_title_asks(spark, tables_of_documents, name):
    found = QUERIES[name](spark, tables_of_documents).select("anime_id").distinct().collect()
    assert {r.anime_id for r in found} == set(range(1, 41))


def test_the_evaluation_is_of_all_lists(spark, tables_of_documents):
    lists = {r.anime_id: r["count"] for r in QUERIES["rec_topk"](spark, tables_of_documents).groupBy("anime_id").count().collect()}
    facts = QUERIES["rec_eval"](spark, tables_of_documents).first()
    assert facts.titles == len(lists) == 40 and facts.recommendation_rows == sum(lists.values())
    assert facts.titles_with_fewer_than_k == sum(n < 10 for n in lists.values())
    shared = QUERIES["serve_shared_tags"](spark, tables_of_documents).where("anime_id % 13 <> 0").collect()
    genres = {"en", "fi"}
    expected = sum(bool(genres & set(r.shared.split("|"))) for r in shared) / len(shared)
    assert QUERIES["rec_eval_overlap"](spark, tables_of_documents).first().overlap == pytest.approx(expected, abs=1e-6)
    assert QUERIES["serve_recommend"](spark, tables_of_documents).first().anime_id == 40
    assert QUERIES["overview_kpis"](spark, tables_of_documents).first().titles_with_recommendations == 40


@pytest.mark.parametrize("skip", [True, False])
def test_titles_whose_picks_lie_below_the_held_cosines_ask_again(random_profiles, monkeypatch, skip):
    monkeypatch.setattr(tiles, "HELD", 3)
    monkeypatch.setattr(tiles, "ALL_HELD", 8 * 112 * 4)  # four titles in a pack
    expected = brute_force(random_profiles.toPandas(), 7, skip)
    pairs = best_pairs(random_profiles, random_profiles.where("eligible"), 7, skip, 50, 40).toPandas()
    pairs = pairs.sort_values(["anime_id", "score", "similar_id"], ascending=[True, False, True])
    assert {int(q): [(int(c), round(float(s), 5)) for c, s in zip(g.similar_id, g.score)] for q, g in pairs.groupby("anime_id")} == expected


def test_candidates_are_not_shuffled_to_the_queries(random_profiles):
    """Only the titles that ask are dealt over tasks; candidates are read by each task."""
    packed = random_profiles.select(*tiles.PROFILE).repartition(2).mapInArrow(lambda batches: tiles._packs(batches, 20), "number bigint, packed binary")
    blocks = tiles.settle(packed, "blocks")
    met = tiles._met(packed, blocks, tiles.PICK + ", again binary", 7, True, None, None, 1)
    plan = met._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "CartesianProduct" in plan and plan.count("Exchange") == 1
    assert met.select("anime_id").distinct().count() > 150


def test_lists_need_only_the_best_of_each_slot(random_profiles):
    pairs = best_pairs(random_profiles, random_profiles.where("eligible"), 20, True).toPandas().sort_values(["anime_id", "score", "similar_id"], ascending=[True, False, True])
    short = best_pairs(random_profiles, random_profiles.where("eligible"), 20, True, lists=3).toPandas().sort_values(["anime_id", "score", "similar_id"], ascending=[True, False, True])
    best = pairs.drop_duplicates(["anime_id", "slot"]).groupby("anime_id").head(3)
    assert best.reset_index(drop=True).equals(short.reset_index(drop=True))


def test_repeated_and_missing_ids_can_ask_and_be_picked(spark):
    schema = "mal_id bigint, term_ids array<int>, weights array<double>, tags array<string>, series_rule string, series_codes array<string>, slot string, eligible boolean"
    rows = [(i, [0, 1 + (i or 0) % 3], [0.6, 0.8], ["x"], None, [], f"s{i}", True) for i in (1, 2, 2, 3, None)]
    rows.append((9, [0, 0, 5], [0.3, 0.3, 0.8], ["x"], None, [], "s9", True))  # a term twice has the weight of one in a dense product
    df = spark.createDataFrame(rows, schema)
    found = best_pairs(df, df, 10, True).toPandas()
    assert found.anime_id.isna().sum() == 6 and (found.anime_id == 2).sum() == 8 and not (found.anime_id == found.similar_id).any()
    pair = found[(found.anime_id == 9) & (found.similar_id == 1)].iloc[0]
    assert pair.text_cosine == pytest.approx(0.18)
    assert best_pairs(df.where("mal_id = 77"), df, 10, True).count() == 0
    assert best_pairs(df, df.where("mal_id = 77"), 10, True).count() == 0
