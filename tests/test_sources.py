"""Reading the snapshot, the pages and the tag reference."""

import csv
import io
import json
import random

import pytest

from titleworks.schemas import SNAPSHOT_COLUMNS
from titleworks.sources import pages as P
from titleworks.sources import sinks as S
from titleworks.sources.snapshot import MissingColumns, missing_columns, read_snapshot


def write_snapshot(path, rows, columns=None):
    columns = columns or [*SNAPSHOT_COLUMNS, "image_url"]
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, columns, restval="")
        writer.writeheader()
        writer.writerows(rows)
    return str(path)


def page(number, ids, more=True, **extra):
    data = [{"mal_id": i, "title": f"T{i}", "genres": [{"mal_id": 1, "name": "Drama"}]} for i in ids]
    return {"page": number, "data": data, "pagination": {"has_next_page": more}, **extra}


def land(folder, pages, endpoint="top"):
    target = folder / f"endpoint={endpoint}"
    target.mkdir(parents=True, exist_ok=True)
    for p in pages:
        text = p if isinstance(p, str) else json.dumps(p)
        (target / f"{len(list(target.iterdir()))}.json").write_text(text, encoding="utf-8")
    return str(folder)


def test_snapshot_keeps_quoted_cells_and_whole_numbers(spark, tmp_path):
    path = write_snapshot(
        tmp_path / "a.csv",
        [
            {"mal_id": "5", "title": 'Say "hi", you', "synopsis": "one\ntwo", "episodes": "28.0", "year": "", "source": "None", "image_url": "x"},
            {"mal_id": "6.0", "title": " pad ", "episodes": "NaN", "members": "123"},
        ],
    )
    first, second = read_snapshot(spark, path).orderBy("mal_id").collect()
    assert list(first.asDict()) == SNAPSHOT_COLUMNS
    assert (first.mal_id, first.title, first.synopsis, first.episodes, first.year, first.source) == (5, 'Say "hi", you', "one\ntwo", 28, None, None)
    assert (second.mal_id, second.title, second.episodes, second.members) == (6, " pad ", None, 123)


def test_missing_columns_are_named_in_order(spark, tmp_path):
    kept = [c for c in SNAPSHOT_COLUMNS if c not in ("members", "title")]
    path = write_snapshot(tmp_path / "b.csv", [{"mal_id": "1"}], kept)
    assert missing_columns(kept) == ["title", "members"]
    with pytest.raises(MissingColumns, match="title, members"):
        read_snapshot(spark, path)


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for part in range(3):
        write_snapshot(tmp_path / "many" / f"{part}.csv", [{"mal_id": str(part * 10 + i)} for i in range(5)])
    rows = read_snapshot(spark, str(tmp_path / "many"), with_order=True).orderBy("_seq").collect()
    assert [r.mal_id for r in rows] == [p * 10 + i for p in range(3) for i in range(5)]


def test_every_file_has_a_header_of_its_own(spark, tmp_path):
    rows = [{"mal_id": str(i), "title": f"title {i}", "type": f"type {i}", "members": str(i * 10)} for i in range(6)]
    swapped = ["type", "title", *[c for c in SNAPSHOT_COLUMNS if c not in ("type", "title")]]
    for k, columns in enumerate((SNAPSHOT_COLUMNS, swapped, ["extra", *reversed(SNAPSHOT_COLUMNS), "more"])):
        write_snapshot(tmp_path / f"{k}.csv", rows[2 * k : 2 * k + 2], columns)
    for multi_line in (True, False):
        found = read_snapshot(spark, str(tmp_path), multi_line, with_order=True).orderBy("_seq").collect()
        assert [(r.mal_id, r.title, r.type, r.members) for r in found] == [(i, f"title {i}", f"type {i}", i * 10) for i in range(6)]
    write_snapshot(tmp_path / "3.csv", rows[:1], [c for c in SNAPSHOT_COLUMNS if c != "demographics"])
    with pytest.raises(MissingColumns, match="3.csv is missing required columns: demographics"):
        read_snapshot(spark, str(tmp_path))


def test_pages_skip_failures_and_stop_at_the_end(spark, tmp_path):
    folder = land(tmp_path, [page(1, [1, 2]), "{broken", page(4, [7]), page(5, [8], more=False), page(6, [9]), {"page": 3}])
    kept = P.read_pages(spark, folder, P.TOP, 10)
    assert [(r.page, r.position, r.item.mal_id) for r in P.page_items(kept).orderBy("page", "position").collect()] == [
        (1, 0, 1), (1, 1, 2), (4, 0, 7), (5, 0, 8),
    ]
    landed = spark.read.schema(P.PAGE).json(f"{folder}/endpoint=top")
    assert sorted(r.page for r in P.failed_pages(landed, 10).collect()) == [2, 3]
    assert sorted(r.page for r in P.failed_pages(landed, 4).collect()) == [2, 3]


def test_a_page_without_pagination_is_not_the_end(spark, tmp_path):
    folder = land(tmp_path, [{"page": 1, "data": [{"mal_id": 1}]}, page(2, [2])])
    assert P.page_items(P.read_pages(spark, folder, P.TOP, 2)).count() == 2


def test_tag_reference_is_sorted_and_complete(spark, tmp_path):
    families = {"genres": [(8, "Drama"), (2, "Adventure")], "explicit_genres": [(9, "Ecchi")], "themes": [(6, "Myth")], "demographics": [(27, "Shounen")]}
    for family, tags in families.items():
        line = json.dumps({"family": family, "data": [{"mal_id": i, "name": n} for i, n in tags]})
        (tmp_path / f"{family}.json").write_text(line)
    tags = P.read_tag_families(spark, str(tmp_path))
    P.write_tag_reference(tags, str(tmp_path / "out"))
    read = P.read_tag_reference(spark, str(tmp_path / "out")).collect()
    assert [tuple(r) for r in read] == [(27, "Shounen", "demographic"), (9, "Ecchi", "explicit_genre"), (2, "Adventure", "genre"), (8, "Drama", "genre"), (6, "Myth", "theme")]
    (tmp_path / "themes.json").unlink()
    with pytest.raises(ValueError, match="themes"):
        P.read_tag_families(spark, str(tmp_path / "*s.json"))


def test_tag_reference_reads_one_json_array(spark, tmp_path):
    path = tmp_path / "tags.json"
    path.write_text(json.dumps([{"genre_id": 1, "name": "Action", "kind": "genre"}], indent=2))
    assert [tuple(r) for r in P.read_tag_reference(spark, str(path)).collect()] == [(1, "Action", "genre")]


def test_unknown_families_do_not_hide_a_known_one(spark):
    rows = [(f"family {i}", [(i, "x")]) for i in range(30)] + [(f, [(1, "A")]) for f in ("genres", "explicit_genres", "themes", "demographics")]
    tags = P.tag_reference(spark.createDataFrame(rows, "family string, data array<struct<mal_id: bigint, name: string>>"))
    assert sorted(r.kind for r in tags.collect()) == ["demographic", "explicit_genre", "genre", "theme"]


def test_the_current_season_s_list_is_read_alike(spark, tmp_path):
    folder = land(tmp_path, [page(1, [5, 6], more=False)], P.SEASON)
    land(tmp_path, [page(1, [9])])
    assert [r.item.mal_id for r in P.page_items(P.read_pages(spark, folder, P.SEASON, 3)).orderBy("position").collect()] == [5, 6]


def test_served_tables_must_all_exist(spark, tmp_path):
    S.write_table(spark.range(3), str(tmp_path), "catalog")
    with pytest.raises(FileNotFoundError, match="recommendations.*metadata"):
        S.load_tables(spark, str(tmp_path), ["catalog", "recommendations"], "metadata")
    S.write_lookup(spark.range(9).selectExpr("id % 3 AS a", "id"), str(tmp_path), "recommendations", "a", ["a", "id"])
    S.write_facts(spark.sql("select 1 as n, cast(null as string) as gone"), str(tmp_path), "metadata")
    tables = S.load_tables(spark, str(tmp_path), ["catalog", "recommendations"], "metadata")
    assert tables["recommendations"].count() == 9
    assert "gone" in tables["metadata"].columns


def torn_file(path, seed, end, mark=""):
    """A snapshot whose cells hold line breaks, quotes, empty lines and lines like records, some longer than a split."""
    random.seed(seed)
    kinds = ["", "plain", 'say "so", she', "two\nlines", "\n\n", '"\n"', 'x,"\n5,6,7', "é\n漢字 😀"]
    rows = []
    for k in range(300):
        text = "".join(random.choices(kinds, k=random.randint(0, 4))) + "line\n" * random.choice([0, 0, 0, 3, 40, 900])
        rows.append({"mal_id": str(k), "title": random.choice(kinds[1:]).strip() or "t", "synopsis": text + random.choice(["", "end"]), "members": str(random.randint(1, 9))})
    out = io.StringIO()
    writer = csv.DictWriter(out, [*SNAPSHOT_COLUMNS, "image_url"], restval="", lineterminator=end)
    writer.writeheader()
    writer.writerows(rows)
    text = out.getvalue()
    if end != "\n":  # as an editor leaves it: line breaks in cells end alike
        text = text.replace(end, "\n").replace("\n", end)
    path.write_bytes((mark + text).encode())
    return rows


@pytest.mark.parametrize(("end", "mark"), [("\n", ""), ("\r\n", "\ufeff")])
def test_large_files_with_line_breaks_in_cells_are_split(spark, tmp_path, end, mark):
    expected = {}
    for name in ("a", "b"):
        for row in torn_file(tmp_path / f"{name}.csv", name, end, mark):
            expected[name, int(row["mal_id"])] = (row["title"], row["synopsis"] or None, int(row["members"]))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1500", "9000", "100000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "100")
            frame = read_snapshot(spark, str(tmp_path), with_order=True)
            assert size != "1500" or frame.rdd.getNumPartitions() > 100
            rows = frame.orderBy("_seq").collect()
            got = [((r["_seq"]["file"][-5], r.mal_id), (r.title, r.synopsis, r.members)) for r in rows]
            assert [k for k, _ in got] == sorted(expected)  # in file order, each once
            assert dict(got) == expected
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    whole = {(r.mal_id, r.title, r.synopsis, r.members) for r in read_snapshot(spark, str(tmp_path), whole_files=True).collect()}
    assert whole == {(k, *v) for (_, k), v in expected.items()}


def test_a_file_that_ends_inside_a_cell_is_refused(spark, tmp_path):
    path = write_snapshot(tmp_path / "a.csv", [{"mal_id": "1", "title": "x"}])
    with open(path, "a") as out:
        out.write('2,"open\n')
    with pytest.raises(ValueError, match="inside a quoted cell"):
        read_snapshot(spark, path)


def test_files_of_two_headers_are_cut_alike_however_many_are_read(spark, tmp_path):
    """Splits with and without a header in one task, and files that are cut by the size of all of them."""
    swapped = [*reversed(SNAPSHOT_COLUMNS), "rank"]
    for name, columns, first in (("a", SNAPSHOT_COLUMNS, 0), ("b", swapped, 1)):
        write_snapshot(tmp_path / f"{name}.csv", [{"mal_id": str(k), "title": f"t {k}", "synopsis": 'one\n"two" ' + "x" * 50} for k in range(first, 2000, 2)], columns)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "100")  # a quarter of all bytes is a split
        rows = read_snapshot(spark, str(tmp_path)).select("mal_id", "title", "synopsis").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in rows) == [(k, f"t {k}", 'one\n"two" ' + "x" * 50) for k in range(2000)]
