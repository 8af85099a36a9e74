"""Text functions, retrieval, folds, sources, generations and the facade on small literal cases."""

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern import api
from lectern.functions import text as T
from lectern.operators import folds, search as S
from lectern.sinks import generations as G
from lectern.sources import vault


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "f, value, expected",
    [
        (T.norm_key, "Zażółć – Test!", "zazoc test".replace(" ", "")), (T.norm_key, "10.1000/ABC.1", "101000abc1"), (T.norm_key, "Привет", ""), (T.norm_key, None, None),
        (T.without_repetition, "a b a b", "a b"), (T.without_repetition, "a a", "a a"), (T.publication_date, "2020/4/5", "2020-04-05"), (T.publication_date, "May 2001", "2001"), (T.publication_date, "n.d.", "n.d."),
        (T.plain_text, "<p>a&amp;b</p> &lt;i&gt;", "a&b <i>"), (T.join_lines, "over-\nlap and\nX-\nRay", "overlap and X- Ray"), (T.collapse_letter_spacing, "T E X T 1 . 2", "TEXT 1.2"),
        (T.is_page_number, " Page xii ", True), (T.ends_sentence, 'He said "no."', True), (T.bad_title, "Full text.pdf", True), (T.bad_title, " deadbeef01 ", True), (T.bad_title, "On scans", False), (T.norm_key, "Straße ﬁne Ａ１", "strassefinea1"), (T.plain_text, "a&eacute;&#8211;&#x41;", "aé–A"), (T.markdown_plain, "# H\n\nSee [a](b) [[N#h|n]] *c*\n\n```\nx\n```", "H\n\nSee a n c"), (T.bad_title, None, True), (T.year, "around 1999-2001", "1999"),
        (T.note_id, "notes/A.md", "70d0a779e7c4af9593717963fc743acfe8c4b6c1"), (T.safe_snippet, "<b>x</b> <mark>y</mark> & z", "x <mark>y</mark> &amp; z"),
    ],
)
def test_text_functions(spark, f, value, expected):
    assert one(spark, f, value) == expected


def test_section_id(spark):
    r = spark.createDataFrame([("70d0a779e7c4af9593717963fc743acfe8c4b6c1", 0, "Intro")], "n string, o int, h string").select(T.section_id(F.col("n"), F.col("o"), F.col("h"))).first()[0]
    assert r == "0a4a819faebb1e8463ba95347d49052b1997a936"


def test_language(spark):
    for text, code in (("Wstępna propozycja projektu badawczego", "pol"), ("Raport dla praktykow prawa oraz podmiotow prawnych", "pol"), ("the cat and the dog in the house of the king", "eng"), ("xyz", None)):
        assert one(spark, lambda c: T.language(F.lit(None).cast("string"), c), text) == code
    assert T.select_languages(["eng", "pol", "osd"], "pl-PL")["languages"] == "pol+eng"
    assert T.select_languages(["eng", "osd"], "pl")["missing"] == "pol"
    assert T.select_languages(["eng", "deu"], "deu+eng", manual=True)["languages"] == "deu+eng"


def test_frontmatter_links_tags(spark):
    assert T.parse_frontmatter("---\nTitle: X\ntags: [a, '#b']\nlist:\n  - p\n  - q\n---\nbody") == {"title": ["X"], "tags": ["a", "b"], "list": ["p", "q"]}
    assert T.parse_frontmatter(None) == {} == T.parse_frontmatter("---\nopen")
    r = one(spark, T.links, "x ![[A#h|d]] [[B]]")
    assert [(x["embed"], x["target"], x["heading"], x["display"]) for x in r] == [(True, "A", "h", "d"), (False, "B", "", "")]
    assert one(spark, T.inline_tags, "#a `#no` x#no #a/b #a") == ["a", "a/b"]


ROWS = [(1, "cat dog", "cat cat mouse zażółć"), (2, "dog", "bird fish"), (3, "fish dog fish", "cat horse cow pig dog"), (4, "cow", "milk"), (5, "x_y Ünïcode", "plain text words here")]


@pytest.mark.parametrize("query, match, exact", [("cat", "cat", False), ("cat dog", "cat AND dog", False), ("fish", "fish", False), ("unicode", "unicode", False), ("cow pig", '"cow pig"', True), ("x_y", '"x y"', False)])
def test_bm25_equals_fts5(spark, query, match, exact):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", ROWS)
    want = con.execute("SELECT rowid, bm25(t, 3.0, 5.0) FROM t WHERE t MATCH ? ORDER BY 2, 1", (match,)).fetchall()
    docs = S.index(spark.createDataFrame(ROWS, "id long, a string, b string"), "id", ["a", "b"])
    got = S.top(S.bm25(docs, {"a": 3.0, "b": 5.0}, S.parse(query, exact)), 10).collect()
    assert [r["key"] for r in got] == [k for k, _ in want]
    assert [r["score"] for r in got] == pytest.approx([x for _, x in want], abs=1e-9)


def test_stored_index_gives_the_same_scores(spark, tmp_path):
    docs = S.index(spark.createDataFrame([*ROWS, (6, None, None)], "id long, a string, b string"), "id", ["a", "b"])
    g = str(tmp_path / "generation=1")
    S.write_index(docs, g)
    w = {"a": 3.0, "b": 5.0}
    for query, exact, any_term in (("cat", False, False), ("cat dog", False, False), ("cat dog", False, True), ("cow pig", True, False), ("dog fish", True, False), ("x_y", False, False), ("none", False, False), ("", False, False)):
        a = {r["key"]: r["score"] for r in S.bm25(docs, w, S.parse(query, exact), any_term).collect()}
        b = {r["key"]: r["score"] for r in S.bm25_stored(spark, g, w, S.parse(query, exact), any_term).collect()}
        assert b == pytest.approx(a), query


def test_empty_query_and_index(spark):
    docs = S.index(spark.createDataFrame(ROWS, "id long, a string, b string"), "id", ["a"])
    assert S.bm25(docs, {"a": 1.0}, S.parse("...")).count() == 0
    none = S.index(spark.createDataFrame([], "id long, a string"), "id", ["a"])
    assert S.bm25(none, {"a": 1.0}, S.parse("cat")).count() == 0


def test_dense_top_k(spark):
    rows = [(i, "document", None, [float(i + 1), 1.0]) for i in range(20)]
    c = spark.createDataFrame(rows, "id long, kind string, item_id long, embedding array<float>")
    got = S.dense(c, [1.0, 0.0], 3).collect()
    assert [r["id"] for r in got] == [19, 18, 17] and [r["similarity"] for r in got] == pytest.approx([0.998752339, 0.998617829, 0.998460353])
    with pytest.raises(Exception, match="another length"):
        S.dense(c, [1.0, 0.0, 0.0], 3).collect()


def test_blend_and_fusion(spark):
    lists = lambda n: spark.createDataFrame([(i, i) for i in range(1, n + 1)], "key long, rank long")
    got = [(r["side"], r["key"]) for r in S.blend(lists(7), lists(3)).orderBy("place").collect()]
    assert got == [*[(0, i) for i in range(1, 6)], (1, 1), (0, 6), (0, 7), (1, 2), (1, 3)]
    f = lambda *k: spark.createDataFrame([(x, i + 1) for i, x in enumerate(k)], "key string, rank long")
    got = {r["key"]: r["score"] for r in S.fuse({"phrase": f("A"), "bm25": f("B", "A"), "dense": f("C")}).collect()}
    assert got == pytest.approx({"A": 0.100435540, "B": 0.032926829, "C": 0.024390244})


def test_diversity(spark):
    rows = [(1, 1, 5, "a"), (2, 2, 5, "b"), (3, 3, 5, "c"), (4, 4, 6, "a"), (5, 5, 7, "d")]
    got = S.diverse(spark.createDataFrame(rows, "rank long, key long, item_id long, text string"), 4).orderBy("place").collect()
    assert [r["key"] for r in got] == [1, 2, 5, 3]


def test_folds():
    assert folds.merge_paragraphs([("paragraph", "It goes", 1), ("paragraph", "on.", 2), ("heading", "H", 2), ("paragraph", "New", 5), ("paragraph", "far", 9)]) == [("paragraph", "It goes on.", 1), ("heading", "H", 2), ("paragraph", "New", 5), ("paragraph", "far", 9)]
    p = lambda *x: [(k, t, 1) for k, t in x]
    assert folds.merge_paragraphs(p(("list_item", "a"), ("list_item", "b"))) == p(("list_item", "a"), ("list_item", "b")) and folds.merge_paragraphs(p(("paragraph", "End."), ("paragraph", "and on"))) == p(("paragraph", "End. and on"))
    assert folds.merge_paragraphs(p(("list_item", "a;"), ("paragraph", "b"))) == p(("list_item", "a;"), ("paragraph", "b")) and folds.merge_paragraphs(p(("heading", "On the"), ("heading", "charter"))) == p(("heading", "On the charter"))
    assert folds.pack(["a" * 3000, "b" * 500, "c" * 3000]) == ["a" * 3000 + "\n\n" + "b" * 500, "c" * 3000]
    assert [len(x) for x in folds.pack(["x" * 30_000])] == [12_000, 12_000, 6_000] and folds.pack([]) == []
    units = folds.evidence_units("One two. Three! " + "w " * 900)
    assert units[0] == (0, 8, "One two.") and all(z - a <= 800 for a, z, _ in units) and folds.evidence_units("") == []
    assert folds.pack_context(["a" * 5000, "b" * 5000], 3_400) == ["a" * 3200] and folds.context_size(100) == 4096
    with pytest.raises(ValueError):
        folds.context_size(10**7)


def test_sources(spark, tmp_path):
    for p in ("Notes/kept.md", ".git/x.md", ".obsidian/y.md", "img/p q.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("# T\n")
    assert [r["relative_path"] for r in vault.notes(spark, str(tmp_path)).collect()] == ["Notes/kept.md"]
    assert [(r["relative_path"], r["content_type"]) for r in vault.assets(spark, str(tmp_path)).collect()] == [("img/p q.png", "image/png")]
    text = "line\n" * 100
    assert "".join(vault.cut_pages(text, 7)) == text and len(vault.cut_pages(text, 7)) == 7 and vault.cut_pages("", 3) == [""]
    blobs = spark.createDataFrame([(1, text, 2), (2, None, None)], "attachment_id long, text string, pages int")
    assert vault.recovered_pages(blobs).count() == 3


def test_generations(spark, tmp_path):
    root = str(tmp_path / "g")
    assert G.change_report(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string"), spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k long, v string"), "k", "v").orderBy("key").collect() == [(1, "deleted"), (2, "unchanged"), (3, "modified"), (4, "added")]
    first = G.reserve(spark, root)
    G.write(spark.range(3), first, "items")
    G.publish(spark, root, first, {"items": 1})
    second = G.reserve(spark, root)
    G.write(spark.range(0), second, "items")
    with pytest.raises(ValueError):
        G.publish(spark, root, second, {"items": 1})
    assert G.current(spark, root)["generation"] == first and len(G.recover(spark, root)) == 1
    third = G.reserve(spark, root)
    G.write(spark.range(5), third, "items")
    G.publish(spark, root, third, {"items": 1})
    (tmp_path / "g" / "current.json").write_text("damaged")
    assert G.current(spark, root)["generation"] == first
    h = spark.createDataFrame([(i, f"2024-01-0{i} 00:00:00") for i in range(1, 5)], "id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted(r["id"] for r in G.prune(h, "id", "at", keep=2, now="2024-01-05").collect()) == [3, 4]
    kept = G.upsert(spark.createDataFrame([(1, "a", 9), (2, "b", 8)], "k long, v string, made long"), spark.createDataFrame([(1, "a"), (3, "c")], "k long, v string"), "k", "v")
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a", 9), (3, "c", None)]


def test_stream(spark, tmp_path):
    from lectern.streaming.ingest import monthly_links

    df = spark.createDataFrame([(1, "2024-01-03 00:00:00"), (1, "2024-01-03 00:00:00"), (2, "2024-01-04 00:00:00")], "id long, imported_at string").withColumn("imported_at", F.col("imported_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    q = monthly_links(spark, str(tmp_path / "in"), df.schema).writeStream.outputMode("update").format("memory").queryName("links").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM links").first()[0] == 2


def test_facade(spark, write):
    docs = [{"doc_id": i, "text": t, "title": "t", "lang": "en"} for i, t in enumerate(["cat dog", "dog", "the contested theory", None])]
    d = write({"documents": docs, "items": [{"id": 1, "title": "x", "creators_json": '[{"creatorType":"author","firstName":"Ada","lastName":"L"}]'}]})
    lib = api.Library(spark, d)
    assert [r["key"] for r in lib.search("cat").collect()] == [0] and lib.reason == "no embedding service"
    assert [r["id"] for r in lib.author("ada l").collect()] == [1] and lib.pages(1).count() == 0 and lib.item(1).count() == 1
    assert lib.search("cat", filters=api.Filters(collections=())).count() == 0
    assert api.Filters.parse({"collections": "[1, 2]", "from": "2020-1-1", "offset": "-3"}) == api.Filters(collections=(1, 2))
    now = [0.0]
    c = api.Cache(lambda: now[0])
    for i in range(25):
        c.put(str(i), i)
    assert c.get("0") is None and c.get("24") == 24
    now[0] = 4000
    assert c.get("24") is None


def library_with_chunks(spark, write, tables, chunks):
    """A folder whose chunks (id, item_id, kind, title, embedding) have ids that are also ids of documents."""
    d = write(tables)
    rows = [(i, "veld-embed-base", 2, k, item, t, e, f"text {i}") for i, item, k, t, e in chunks]
    spark.createDataFrame(rows, "id long, model string, dimensions int, kind string, item_id long, title string, embedding array<float>, text string").write.mode("overwrite").parquet(f"{d}/semantic_chunks.parquet")
    return d


def test_fusion_keeps_kinds_apart(spark, write):
    docs = [{"doc_id": i, "text": t, "title": f"document {i}"} for i, t in enumerate(["cat", "dog", "bird"], 1)]
    d = library_with_chunks(spark, write, {"documents": docs}, [(1, None, "note", "chunk 1", [1.0, 0.0]), (2, None, "note", "chunk 2", [0.0, 1.0])])
    got = api.Library(spark, d, lambda q: [1.0, 0.0]).search("cat", "hybrid").collect()
    assert [(r["kind"], r["key"], r["title"]) for r in got] == [("document", 1, "document 1"), ("chunk", 1, "chunk 1"), ("chunk", 2, "chunk 2")]
    assert [r["score"] for r in got] == pytest.approx([-(2.8 + 1.35) / 41, -1 / 41, -1 / 42])
    assert {(r["kind"], r["key"]) for r in S.hybrid(spark, d).collect()} == {("chunk", 1), ("chunk", 2)}
    assert [r["title"] for r in api.Library(spark, d, lambda q: [1.0, 0.0]).search("cat", "dense").collect()] == ["chunk 1", "chunk 2"]


def test_filters_hold_for_every_list(spark, write):
    items = [{"id": 1, "collections_json": "[7]", "date_created": "1990-05"}, {"id": 2, "collections_json": "[8]", "date_created": "2001"}, {"id": 3, "collections_json": None, "date_created": "n.d."}]
    docs = [{"doc_id": i, "text": "cat", "title": "t", "item_id": i} for i in (1, 2, 3)]
    chunks = [(10 * i, i, "note", "t", [1.0, 0.1 * i]) for i in (1, 2, 3)] + [(100, None, "obsidian", "v", [1.0, 0.0])] + [(1000 + i, 1, "note", "t", [0.5, 1.0]) for i in range(300)]
    d = library_with_chunks(spark, write, {"documents": docs, "items": items}, chunks)
    lib = api.Library(spark, d, lambda q: [1.0, 0.0])
    keys = lambda method, **f: {r["key"] for r in lib.search("cat", method, filters=api.Filters(**f)).collect()}
    assert keys("dense", collections=(8,)) == {20, 100} and keys("hybrid", collections=(8,)) == {2, 20, 100}
    assert keys("hybrid", collections=(), folders=()) == set() and keys("dense", collections=(8,), folders=()) == {20}
    assert keys("bm25", published_from="1990-05-31", published_to="1999-12-31") == {1}
    assert keys("hybrid", published_from="2000-01-01", folders=()) == {2, 20}
    assert keys("dense", collections=(8,), folders=("Inbox",)) == {20} and lib.reason == "chunks without folders"
    assert len(keys("dense", offset=200)) == api.Library.PAGE + 1


def test_registry_without_and_with_queries(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) > 100
    assert all(f"p{n}_found" in names for n in (2, 4))


def test_lexical_indexes_stored_and_filtered(spark, write, tmp_path):
    items = [{"id": 1, "title": "Survey of rivers", "creators_json": '[{"firstName":"Ada","lastName":"Lo"}]', "metadata_json": '{"place":"Lissau","note":" "}', "tags_json": '["map"]', "collections_json": "[5]", "date_added": "2020-01-05 10:00:00"}]
    items += [{"id": i, "title": f"Other {i}", "collections_json": "[]", "date_added": "2021-01-01 00:00:00"} for i in range(2, 9)]
    notes = [{"note_id": "n", "relative_path": "A/n.md", "folder": "A", "title": "Survey note", "imported_at": dt.datetime(2020, 1, 1)}, {"note_id": "m", "relative_path": "B/m.md", "folder": "B", "title": "x", "imported_at": dt.datetime(2020, 1, 1), "removed_at": dt.datetime(2021, 1, 1)}]
    sections = [{"section_id": f"{n}{i}", "note_id": n, "ordinal": i, "heading": "h", "markdown": "a survey" if i < 2 else "text"} for n in "nm" for i in range(6)]
    pages = [{"id": i, "attachment_id": 1, "item_id": 1 if i == 1 else 2, "page_number": i, "text": "the survey" if i < 3 else "page"} for i in range(1, 8)]
    d = write({"items": items + items[:1], "obsidian_notes": notes, "obsidian_sections": sections, "document_pages": pages, "zotero_collections": [{"collection_id": 5, "name": "C"}]})
    lib = api.Library(spark, d, indexes=str(tmp_path / "ix"))
    fresh = sorted(map(tuple, lib.lexical("survey").collect()))
    lib.refresh()
    stored = sorted(map(tuple, lib.lexical("survey").collect()))
    assert [x[:2] for x in stored] == [x[:2] for x in fresh] and {x[:2] for x in stored} == {("document", "1"), ("document", "2"), ("metadata", "1"), ("obsidian", "n0"), ("obsidian", "n1"), ("obsidian", "n2"), ("obsidian", "n3"), ("obsidian", "n4"), ("obsidian", "n5")}
    keys = lambda f, scope="all": {tuple(r)[:2] for r in lib.lexical("survey", scope, filters=api.Filters.parse(f)).collect()}
    assert {k for k in keys({"collections": "[5]"}) if k[0] != "obsidian"} == {("document", "1"), ("metadata", "1")} and {k for k in keys({"collections": [0]}) if k[0] != "obsidian"} == {("document", "2")}
    assert not [k for k in keys({"folders": []}) if k[0] == "obsidian"] and keys({"folders": ["B"]}, "obsidian") == set() and keys({"added_to": "2020-12-31"}, "documents") == {("document", "1")}
    assert lib.lexical("survey", "nothing").count() == 0 and lib.lexical("", "all").count() == 0
