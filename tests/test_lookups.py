"""Lookups, readiness, evidence, geometry."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import library as L


def test_heading_paths(spark):
    rows = [("a", "n", 0, "", 0), ("b", "n", 1, "A", 1), ("c", "n", 2, "B", 2), ("d", "n", 3, "C", 3), ("e", "n", 4, "D", 2), ("f", "n", 5, "E", 1), ("g", "n", 6, "F", 3)]
    got = {r[0]: r[1] for r in L.heading_paths(spark.createDataFrame(rows, "section_id string, note_id string, ordinal long, heading string, heading_level int")).collect()}
    assert got == {"a": "", "b": "A", "c": "A › B", "d": "A › B › C", "e": "A › D", "f": "E", "g": "E › F"}


def test_locate(spark):
    b = spark.createDataFrame([(1, 7, 1, 1, "one two three"), (2, 7, 2, 3, "the <b>needle</b> here"), (3, 7, 4, 4, "x")], "id long, attachment_id long, page_start int, page_end int, text string")
    w = spark.createDataFrame([(1, 7, "Needle  here!", 4), (2, 7, "absent", 3), (3, 7, "absent", None)], "key long, attachment_id long, needle string, page int")
    assert sorted(map(tuple, L.locate(b, w).collect())) == [(1, 2, 2), (2, 2, 3), (3, 1, 1)]


def test_evidence_and_readiness(spark):
    c = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 1, 1), (1, 1, 2, 9)], "occurrence int, source int, start int, stop int")
    assert L.validate_evidence(c, spark.createDataFrame([(1, 1, 3)], "occurrence int, source int, units int")).count() == 1
    i = spark.createDataFrame([("model", "m"), ("model_identity", "old"), ("completed_at", "x"), ("clean_text_completed_at", "s"), ("chunks", "3")], "key string, value string")
    assert tuple(L.ready(i, "m", "new", "s").first()) == (False, True, False) and tuple(L.ready(i, "m", "old", "s").first()) == (True, True, True)
    assert tuple(L.ready(i.limit(0), "m", "old", "s").first()) == (False, False, False)
    assert L.info(spark.createDataFrame([("notes", "3"), ("path", "x")], "key string, value string")) == {"notes": 3, "path": "x"}


def test_geometry_titles_history(spark):
    w = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 1.0, "a"), (1, 6.0, 0.0, 9.0, 1.0, "b"), (1, 0.0, 5.0, 5.0, 6.0, "c")], "page int, x0 double, y0 double, x1 double, y1 double, word string")
    box = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 2.0)], "key long, page int, x0 double, y0 double, x1 double, y1 double")
    assert tuple(L.words_in_boxes(w, box).first()) == (1, "a b")
    t = spark.createDataFrame([(1, 10.0, 100.0, 18.0, "On the early charter", 1), (1, 14.0, 100.0, 17.5, "of the river towns", 2), (1, 90.0, 100.0, 30.0, "far below on the page", 3)], "document long, top double, height double, size double, text string, position int")
    assert L.title_guess(t).first()["title"] == "On the early charter of the river towns"
    h = spark.createDataFrame([(1, "g1", 5, "2024-01-01"), (2, "g2", 6, "2024-01-02")], "id long, generation string, item_id long, updated_at string")
    assert [tuple(r)[:3] for r in L.history_view(h, "g2").collect()] == [(2, "g2", 6), (1, "g1", None)]
    assert L.guarded("r", "a/b.md") and not L.guarded("r", "../x") and not L.guarded("r", "/etc") and not L.guarded("r", "a/../../x")


def test_embed_and_pivot(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, text string")
    got = {r["key"]: list(r["embedding"]) for r in L.embed(df, lambda t: [[3.0, 4.0] if x == "x" else [0.0, 0.0] for x in t], 2).collect()}
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["b"] == [0.0, 0.0]
    p = L.pivot_fields(spark.createDataFrame([(1, "a", "x"), (1, "a", "b"), (1, "c", "d"), (2, None, "q")], "id long, f string, v string"), "id", "f", "v").collect()
    assert [(r["id"], r["fields"]) for r in p] == [(1, {"a": "b", "c": "d"})]
    assert L.ordered_children(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id long, o int, n string"), "id", "o", "n").first()["children"][0]["n"] == "a"
    assert spark.createDataFrame([("A B and C D; E",)], "x string").select(L.split_authors(F.col("x"))).first()[0] == ["A B", "C D", "E"]


def test_lines_without_layout():
    from lectern.operators import reading as R

    assert [R.line_class(x) for x in ("CHARTERS OF THE TOWN", "On maps ....... 12", "12 14 15", "3 Lo, On the charter of the town and of all the courts and archives in it, 1990", "- a thing", "A sentence goes on", "1. Introduction")] == ["heading", "toc_entry", "table_row", "footnote", "list_item", "paragraph", "heading"]
    text = "Running Title\n\nThe clerk saw the har-\nvest of the town.\n\nand more.\n\nNew one here.\n\n12\nTHE END"
    assert R.line_blocks(text, ["Running Title"]) == [("paragraph", "The clerk saw the harvest of the town. and more."), ("paragraph", "New one here."), ("heading", "THE END")]
    assert R.line_blocks(None, None) == [] and len(R.line_blocks("word and more.\n" * 400, None)) == 13  # 31 lines reach LEAST


def test_runs(spark, tmp_path):
    from lectern.operators import reading as R
    from lectern.sinks import generations as G

    assert R.stages(False, True)[:2] == ["empty_library", "vault"] and "vault" not in R.stages(True, False) and R.stages(True, True)[-1] == "publish"
    with pytest.raises(ValueError):
        R.stages(False, False)
    assert R.registry(["a", "b"], ["b", "c", "", " d e "]) == ["a", "b", "c"]
    seen, path = [], str(tmp_path / "queue.json")

    def embed(model):
        if model == "b" and len(seen) == 1:
            seen.append("fails")
            raise OSError
        seen.append(model)

    with pytest.raises(OSError):
        R.Queue(spark, path).run(["a", "b", "c", "b"], embed)
    assert R.Queue(spark, path).left() == ["b", "c"] and R.Queue(spark, path).run(["x"], embed) == ["b", "c"] and R.Queue(spark, path).left() == []
    (tmp_path / "bad.json").write_text("{")
    assert G.read_json(spark, str(tmp_path / "bad.json")) is None and not (tmp_path / "bad.json").exists()


def test_annotations_and_universe(spark):
    from lectern.operators import reading as R
    from lectern.operators import resolve as E

    a = spark.createDataFrame([(1, 1, 1, "Highlight", "x", None), (2, 1, 1, "Highlight", "x", None), (3, 1, 1, "Link", "x", None), (4, 1, 1, "Text", " ", "")], "id long, attachment_id long, page_number int, annotation_type string, text string, comment string")
    assert [r["id"] for r in R.page_annotations(a).collect()] == [1]
    items = spark.createDataFrame([(1, "book"), (2, "note"), (3, "book"), (4, None)], "id long, item_type string")
    files = spark.createDataFrame([(10, None), (11, 1), (12, None)], "id long, parent_id long")
    gone = spark.createDataFrame([(3,), (12,)], "id long")
    assert sorted((r["id"], r["item_type"]) for r in E.universe(items, files, gone).collect()) == [(-10, "standaloneAttachment"), (1, "book"), (4, None)]
    row = lambda **x: E.dedupe_key(lambda c: F.lit(x.get(c)).cast("string"))
    keys = spark.range(1).select(row(id="1", doi="10.1/X", isbn="9").alias("a"), row(id="1", isbn="978-3").alias("b"), row(id="1", title="T").alias("c"), row(id="1", title="T", date_created="May 1990", creators_json='[{"lastName":"Lo"}]').alias("d"), row(id="1", doi="10.1/X", item_type="standaloneAttachment").alias("e")).first()
    assert tuple(keys) == ("doi:101x", "isbn:9783", "id:1", "title:t|1990|lo", "id:1")
