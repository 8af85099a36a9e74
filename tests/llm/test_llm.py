"""The subpackage's operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and brute force."""

import datetime as dt
import itertools
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("lectern.llm.registry")

from lectern.llm import foldhash, hnsw, lstm, p01_formatting as p1, p03_markup as p3, p05_scans as p5, p06_survivors as p6, p07_neighbours as p7, p08_tokens as p8, p09_packing as p9, p10_stuffing as p10, registry  # noqa: E402

CLASH = "h1 h2 class_id first_id n ok rn node shard part ids cos body header inline key size stored asks words clause covered n_tokens bucket rank plain_text value field"
PATH = p8.BYTE_BPE


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_query_on_empty_tables(spark, write):
    d = write({}, CLASH)
    for m in registry.modules():
        for name, q in m.QUERIES.items():
            assert q(spark, d).count() == 0, name


# 1


def test_fold_hash_agrees_with_canonical_strings():
    r = random.Random(1)
    marks = "\u0301\u0328\u0323\u0308"
    canon = lambda s: "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFD", s).casefold()) if c not in " .-\u200b\u00ad\n")
    texts = ["".join(r.choice("aAbBéÉßSs .-\u200b\u00ad\n" + marks) for _ in range(r.randint(0, 9))) for _ in range(400)]
    h = foldhash.hash_texts(texts)
    for i, j in itertools.combinations(range(0, 400, 3), 2):
        a, b = canon(texts[i]), canon(texts[j])
        same = unicodedata.normalize("NFC", a) == unicodedata.normalize("NFC", b)
        assert foldhash.same(texts[i], texts[j]) == same
        assert (h[i] == h[j]).all() == same


def test_fold_hash_of_very_long_texts(monkeypatch):
    text = "Ab é\u0301c. " * 5000
    whole = foldhash.hash_texts([text, text.upper()])
    monkeypatch.setattr(foldhash, "BLOCK", 1000)
    assert (foldhash.hash_texts([text, "x", text.upper()])[[0, 2]] == whole).all()


def test_copies(spark, write):
    name = '[{"creatorType":"author","firstName":"Ada","lastName":"Lo"}]'
    base = {"title": "On the Charter", "doi": "10.5555/x.1", "creators_json": name, "date_created": "1990-01"}
    items = [base | {"id": 5}, base | {"id": 3, "title": "ON THE  charter."}, base | {"id": 9, "doi": "https://r.example/10. 5555/X.1"}, base | {"id": 7, "creators_json": '[ {"lastName":"LO","firstName":"ada"} ]'}]
    items += [base | {"id": 11, "title": "On the Chartér"}, {"id": 12}, {"id": 13, "title": "", "doi": "", "creators_json": "[]"}, base | {"id": None}, base | {"id": 14, "creators_json": "not json"}]
    items += items[:2]
    groups = [{"item_id": 1, "match_method": "title", "match_key": "A b|1990|lo"}, {"item_id": 2, "match_method": "title", "match_key": "LO | 1990|a B."}, {"item_id": 3, "match_method": "doi", "match_key": "A b|1990|lo"}, {"item_id": 4, "match_method": None, "match_key": None}]
    d = write({"items": items, "duplicate_groups": groups + groups[:1]}, CLASH)
    assert rows(p1.p1_found(spark, d)) == [("duplicate_groups", 1, 2), ("items", 12, 13), ("items", 3, 5), ("items", 3, 7), ("items", 3, 9)]
    assert rows(p1.p1_classes(spark, d)) == [("duplicate_groups", 1, 2), ("duplicate_groups", 3, 1), ("duplicate_groups", 4, 1), ("items", 11, 1), ("items", 12, 2), ("items", 14, 1), ("items", 3, 4)]


def test_rows_of_equal_hash_but_other_content_stay_apart(spark, write, monkeypatch):
    items = [{"id": i, "title": t} for i, t in enumerate(["a", "b", "a"])]
    d = write({"items": items})
    df = spark.read.parquet(f"{d}/items.parquet")
    assert rows(p1.copies(df, "id", (p1.Field("title"),))) == [(0, 0), (1, 1), (2, 0)]
    real = p1.record_hash  # all hashes of the first two seeds are equal: the comparison keeps the records apart
    monkeypatch.setattr(p1, "record_hash", lambda f, fields, seed=0: real(f, fields, seed) * (seed > 1))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(p1)
    try:
        assert rows(p1.copies(df, "id", (p1.Field("title"),))) == [(0, 0), (1, 1), (2, 0)]
    finally:
        cloudpickle.unregister_pickle_by_value(p1)
    assert not p1._same(("a",), ("b",), (p1.Field("title"),)) and p1._same(("x|y",), (" Y|x",), (p1.Field("k", "parts"),))


# 3


@pytest.mark.parametrize(
    "body, expected",
    [
        ("plain text, 5 * 3 * 2 and a < b, c > d; x<y or y>x? $5 to $10, ~2 or 3~4, C# [12] {3} AT&T fig_02_v3 | row", ""), ("# Head\n\ntext", "markdown"), ("**bold** word", "markdown"), ("a [l](http://x.example) b", "markdown"), ("1. a\n2) b", "markdown"),
        ("<p>a</p>", "html"), ("a &mdash; b", "html"), ("&lt;i&gt;x&lt;/i&gt;", "html"), ("see [[Note|n]]", "wiki"), ("== H ==\ntext", "wiki"), ("'''b''' c", "wiki"), ("{| class=x\n|-\n| a || 1\n|}", "wiki"),
        (r"a $E = mc^2$ b", "latex"), ("\\begin{itemize}\n\\item x\n\\end{itemize}", "latex"), ("---\ntags: [a]\n---\nplain", ""), ("```\n<b> [[x]] $a_1$ **b**\n```", "markdown"), ("x `<b> [[y]]` z", "markdown"), ("<pre><code>a **b** [[c]]</code></pre>", "html"), ("", ""), ("  \r\n ", ""),
        ("# H\r\n\r\n[[a]] <b>c</b> \\emph{d}", "html latex markdown wiki"),
    ],
)
def test_syntaxes_named_by_the_network(body, expected):
    (bs, x), = p3.labelled(p3.model(), [body])
    assert " ".join(sorted(s for s, f in zip(p3.SYNTAXES, p3.found(x)) if f)) == expected if bs else not expected


def test_written_bodies_are_told_apart():
    """Held-out accuracy on bodies of another seed."""
    cuts, labels = p3.examples(200, 12)
    logits = np.concatenate([x for _, x in [(bs, p3.lstm.forward(p3.model(), [[p3.features(b) for b in bs]])[0]) for bs in cuts]])
    y = np.concatenate(labels)
    k = len(p3.CLASSES)
    assert ((logits[:, k:] >= 0) == y[:, 1:]).mean() > 0.98 and (logits[:, :k].argmax(1) == y[:, 0]).mean() > 0.95


def test_network_decides():
    zeros = {k: np.zeros_like(v) for k, v in p3.model().items()} | {"v": np.full_like(p3.model()["v"], -1)}
    assert not any(p3.found(x).any() for _, x in p3.labelled(zeros, ["# Head", "<p>a</p>", "[[a]]"]))


def test_markup_is_taken_off_at_any_depth():
    assert p3.plain("\\textbf{" * 40 + "deep" + "}" * 40) == "deep" and p3.plain("&lt;b&gt;x&lt;/b&gt; *a ~~b ==c== d~~*") == "x a b c d"
    long = "$" + " + ".join(["x_i"] * 200) + "$"
    assert p3.plain(f"see {long} here") == f"see {long} here"
    deep = p3.blocks("<div>" * 3000 + "text" + "</div>" * 3000)
    assert len(deep) == 6001 and len(deep[3000].path.names(9999)) == 3000


BODIES = ["# Head one\n\nSome *text* here.\n\n- a\n- b\n\n```\nx = 1\n```", "<h2>Title</h2><p>Text &amp; more</p><ul><li>x</li></ul>", "== Wiki ==\n[[A|b]] text", "Plain words only here.", "\\section{S}\n\n$$\nE = mc^2\n$$\n\nText \\emph{x}."]


def test_markup(spark, write):
    notes = [{"note_id": str(i), "markdown": b} for i, b in enumerate(BODIES * 6)] + [{"note_id": "n", "markdown": None}, {"note_id": None, "markdown": "# x"}, {"note_id": "e", "markdown": " "}]
    d = write({"obsidian_notes": notes + notes[:2], "notes": [{"id": 1, "note_html": "<p>" + "long text. " * 20_000 + "</p>"}]}, CLASH)
    got = set(rows(p3.p3_found(spark, d)))
    want = {("obsidian_notes", str(i), s) for i, b in enumerate(BODIES * 6) for s in {0: ["markdown"], 1: ["html"], 2: ["wiki"], 3: [], 4: ["latex"]}[i % 5]} | {("notes", "1", "html")}
    assert len(got & want) >= 0.95 * len(want) and not got - want
    text = {(r[0], r[1]): r[2] for r in p3.p3_text(spark, d).collect()}
    assert "# Head one" in text["obsidian_notes", "0"] and "- a\n- b" in text["obsidian_notes", "0"] and "```\nx = 1\n```" in text["obsidian_notes", "0"] and "*text*" not in text["obsidian_notes", "0"]
    assert text["obsidian_notes", "n"] == "" and "E = mc^2" in text["obsidian_notes", "4"] and "Text & more" in text["obsidian_notes", "1"] and len(text["notes", "1"]) > 200_000


def test_lstm_gradients():
    r = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in lstm.init(20, 3, 4, 5, 1).items()}
    docs = [[r.integers(0, 20, 3) for _ in range(n)] for n in (1, 3, 2)]
    w = r.normal(size=(6, 5))
    _, g = lstm.gradients(p, docs, lambda z: ((z * w).sum(), w))
    for k in p:
        at = tuple(int(r.integers(0, n)) for n in p[k].shape)
        p[k][at] += 1e-3
        up = (lstm.forward(p, docs)[0] * w).sum()
        p[k][at] -= 2e-3
        down = (lstm.forward(p, docs)[0] * w).sum()
        p[k][at] += 1e-3
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-3), k


# 5


def test_scans(spark, write):
    body = "The charter describes an account of the harvest and the household in the province.\nThe survey of the district contradicts nearly everything."
    pages = [{"id": i, "attachment_id": 1 + i // 8, "page_number": 1 + i % 8, "text": f"READING THE CHARTER    {10 + i % 8}\n{body}\nA well-known long-term district of the harvest."} for i in range(40)]
    pages[3]["text"] = "READING THE CHARTER 13\nThe chartcr describes an accourit of the har-\nvest and the household in a well-\nknown province. The district."
    pages += [{"id": 90, "text": None}, {"id": 91, "text": "  "}, {"id": 92, "attachment_id": None, "page_number": None, "text": body}, {"id": None, "text": body}, {"id": 93, "attachment_id": 9, "page_number": 1, "text": body * 500}]
    blocks = [{"id": 1, "attachment_id": 1, "page_start": 2, "page_end": 2, "text": "READING THE CHARTER 11 The survey of the dis-  trict contradicts nearly everything."}, {"id": 2, "attachment_id": 1, "page_start": 3, "page_end": 3, "text": "12"}, {"id": 3, "attachment_id": 1, "page_start": 3, "page_end": 3, "text": body}]
    d = write({"document_pages": pages + pages[:3], "clean_document_blocks": blocks + blocks[:1]}, CLASH)
    got = set(rows(p5.p5_found(spark, d)))
    pages_ = {("document_pages", i, n) for i in range(40) for n in ("header", "page_number")}
    assert got == pages_ | {("document_pages", 3, "misread"), ("document_pages", 3, "hyphen"), ("clean_document_blocks", 1, "header"), ("clean_document_blocks", 1, "page_number"), ("clean_document_blocks", 1, "hyphen"), ("clean_document_blocks", 2, "page_number")}
    text = {(r[0], r[1]): r[2] for r in p5.p5_text(spark, d).collect()}
    assert text["document_pages", 3] == "The charter describes an account of the harvest and the household in a well-known province. The district."
    assert {tuple(r)[2:] for r in p5.p5_repairs(spark, d).collect()} == {("chartcr", "charter"), ("accourit", "account")}


def test_running_line_beside_a_number_alone(spark, write):
    """The title never stands outermost: below the number at the head, above it at the foot, or the number stands next to the title."""
    body = "\n".join(f"the {w} of the province contradicts the survey." for w in ("harvest", "household", "charter"))
    page = lambda a, p: {1: f"{40 + p}\nREADING THE CHARTER\n{body}", 2: f"{body}\nREADING THE CHARTER\n[{40 + p}]", 3: f"READING THE CHARTER\n{40 + p}\n{body}"}[a]
    d = write({"document_pages": [{"id": 10 * a + p, "attachment_id": a, "page_number": p, "text": page(a, p)} for a in (1, 2, 3) for p in range(1, 7)]})
    assert set(rows(p5.p5_found(spark, d))) == {("document_pages", 10 * a + p, n) for a in (1, 2, 3) for p in range(1, 7) for n in ("header", "page_number")}


def test_titles_of_chapters_in_a_long_attachment(spark, write):
    """Each of 40 titles stands on five of 200 pages; a line on two of them is no running line."""
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    pages = [{"id": p, "attachment_id": 1, "page_number": p, "text": f"TREATISE {word(p // 5 * 677).upper() * 4}\nthe survey of {word(p)} ends."} for p in range(200)]
    pages += [{"id": p, "attachment_id": 1, "page_number": p, "text": "Twice written heading\nthe survey ends."} for p in (200, 201)]
    d = write({"document_pages": pages})
    known = {r["attachment_id"]: set(r["keys"]) for r in p5.attachments(spark.read.parquet(f"{d}/document_pages.parquet")).collect()}
    assert known == {1: {p5.line_key(p["text"].split("\n")[0]) for p in pages[:200]}}
    assert p5.clean_block("A text.\n163", 1, 100, [], 100)[0] == "A text." and p5.clean_block("A text.\n163", 1, 10**9, [], 100)[2]


def test_scan_parts():
    assert p5.number_of("xiv") == {14} and p5.number_of("l6O") == {160} and p5.number_of("abc") == set()
    assert p5.cost("accourit", "account") == (0.5, False) and p5.cost("cat", "dog")[0] == np.inf and p5.cost("hcuse", "house") == (1.0, True) and p5.cost("worlt", "world") == (1.0, True)
    assert p5.cost("rnodcm", "modem") == (0.9, False) and p5.cost("archivess", "archives") == (1.0, True) and p5.cost("abc", "abc") == (0.0, False)
    assert p5.index_keys("archivs", 0) & p5.index_keys("archives", 1) and len(p5.index_keys("rn" * 400, 0)) < 4_000
    assert p5.index_keys("accourit", 0) & p5.index_keys("account", 1) and not p5.index_keys("cat", 0) & p5.index_keys("dog", 1)
    assert p5.breaks("a well-\nknown har-\nvest Vor- \nund nach-", False) == [("well", "known"), ("har", "vest"), ("nach", "")]
    assert p5.odd("b@dania") and p5.odd("te0ria") and not p5.odd("1990s") and not p5.odd("abc")


def test_repairs_by_context_and_by_parts(spark, write):
    """Another edit than a confusion needs the words beside it; a word that stands nowhere else is repaired by its parts."""
    page = lambda i, text: {"id": i, "attachment_id": i, "page_number": 1, "text": text}
    pages = [page(i, "The clerk saw the ledger of the town and the harvest there.") for i in range(1, 120)]
    pages += [page(200, "The clerk saw the lxdger of the town."), page(201, "A quite other lxdger altogether."), page(202, "He named it zolatharv3st and zoharv@logy."), page(203, "In 1990s 15 so is l5.")]
    pages += [page(300 + i, f"The {w} stands.") for i, w in enumerate(("zovalor", "mavalon", "havalid", "qavaltur", "sevalmo"))]
    d = write({"document_pages": pages})
    got = {(r["record_id"], r["word"]): r["printed"] for r in p5.p5_repairs(spark, d).collect()}
    assert got[200, "lxdger"] == "ledger" and (201, "lxdger") not in got and not [k for k in got if k[0] == 203]
    assert got == {k: v for k, v in got.items() if k[0] in (200, 202)}


# 6


def test_survivors_against_brute_force(spark, write):
    r = random.Random(5)
    dates = [None, "2020-01-01 00:00:00", "2020-01-01T02:00:00+02:00", "2020-01-02T00:00:00Z", "2019-12-31 23:59:59", "bad"]
    values = ["real", "other", "", " ", "n/a", None, "-", "[s.n.]"]
    src = [{"item_id": r.randint(1, 9), "source_item_id": i, "date_added": r.choice(dates), "annotation_count": r.choice([None, 0, 1, 2]), "metadata_json": r.choice([None, "{", str({k: r.choice(values) for k in "abc"}).replace("None", "null").replace("'", '"')]), "loaded_at": dt.datetime(2024, 1, 1)} for i in range(1, 60)]
    again = [s | {"annotation_count": 9, "loaded_at": dt.datetime(2023, 1, 1)} for s in src[:10]]  # older loads don't hold
    d = write({"item_sources": src + again + src[:4] + [src[0] | {"item_id": None}], "items": [{"id": i, "metadata_json": "{}", "canonical_source_item_id": 1} for i in range(1, 12)]}, CLASH)
    at = {None: None, "bad": None, dates[1]: 1, dates[2]: 1, dates[3]: 2, dates[4]: 0}
    late = lambda s: (at[s["date_added"]] is None, at[s["date_added"]] or 0, s["source_item_id"])
    import json

    fields = lambda s: {k: v for k, v in json.loads(s["metadata_json"]).items() if v in ("real", "other")} if s["metadata_json"] not in (None, "{") else {}
    want = set()
    for i in range(1, 10):
        own = [s for s in src if s["item_id"] == i]
        if len(own) < 2:
            continue
        rep = min(own, key=lambda s: (-(s["annotation_count"] or 0), *late(s)))
        want.add((i, "*", rep["source_item_id"]))
        for k in "abc":
            have = [s for s in own if k in fields(s)]
            if have:
                want.add((i, k, (rep if rep in have else min(have, key=late))["source_item_id"]))
    assert set(rows(p6.p6_found(spark, d))) == want
    sky = set(rows(p6.p6_skyline(spark, d)))
    for s in src:
        dominated = any(o["item_id"] == s["item_id"] and (o["annotation_count"] or 0) >= (s["annotation_count"] or 0) and len(fields(o)) >= len(fields(s)) and late(o) < late(s) for o in src)
        assert ((s["item_id"], s["source_item_id"], s["annotation_count"] or 0, len(fields(s))) in sky) != dominated
    assert p6.p6_items(spark, d).count() == 11


# 7


def _near(vectors, k=5):
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    out = set()
    for i in x:
        best = sorted((j for j in x if j != i), key=lambda j: (-round(float(x[i] @ x[j]), 9), j))[:k]
        out |= {(min(i, j), max(i, j)) for j in best}
    return out


def test_neighbours(spark, write):
    r = np.random.default_rng(2)
    v = {i: r.normal(size=8).astype(np.float32).tolist() for i in range(1, 120)}
    v |= {200 + i: v[1] for i in range(9)} | {300: v[2]}  # equal vectors
    chunk = lambda i, e, m="m": {"id": i, "model": m, "dimensions": 8, "embedding": e}
    c = [chunk(i, e) for i, e in v.items()]
    bad = [chunk(900, None), chunk(901, [0.0] * 8), chunk(902, [1.0] * 7), chunk(903, [float("nan")] * 8), chunk(904, [float("inf")] + [1.0] * 7), chunk(905, v[1], "alone"), chunk(906, v[3], None), chunk(None, v[3])]
    d = write({"semantic_chunks": c + bad + c[:5]}, CLASH)
    got, want = set(rows(p7.p7_found(spark, d))), _near(v)
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)
    n = p7.p7_neighbours(spark, d).toPandas()
    assert n.groupby("id").size().max() == 5 and set(n["id"]) == set(v)


@pytest.mark.parametrize("leaves", [131_072, 1])  # centroids of a second level; random parts where there may be no more centroids
def test_divided_shards(spark, write, monkeypatch, leaves):
    monkeypatch.setattr(p7, "MAX_SHARD", 60)
    monkeypatch.setattr(p7, "MAX_LEAVES", leaves)
    r = np.random.default_rng(3)
    centre = r.normal(size=(12, 8)) * 4
    v = {i: (centre[i % 12] + r.normal(size=8)).astype(np.float32).tolist() for i in range(400)}
    d = write({"semantic_chunks": [{"id": i, "model": "m", "dimensions": 8, "embedding": e} for i, e in v.items()]})
    got, want = set(rows(p7.p7_found(spark, d))), _near(v)
    assert len(got & want) >= 0.95 * len(want)


def test_each_graph_is_built_once(monkeypatch):
    """Batches cut a part anywhere; a part is built once, and its own nodes ask it too."""
    r = np.random.default_rng(4)
    row = lambda part, node, stored: {"node": node, "model": "m", "embedding": r.normal(size=8).astype(np.float32), "size": 8, "shard": 0, "part": part, "stored": stored}
    parts = [[row(p, 100 * p + i, True) for i in range(30)] + [row(p, 1000 + i, False) for i in range(50)] for p in range(3)] + [[row(3, 5000, False)], [row(4, 400 + i, True) for i in range(9)]]
    built = []
    graph = p7.hnsw.Graph
    monkeypatch.setattr(p7.hnsw, "Graph", lambda v, s: built.append(len(v)) or graph(v, s))
    flat = pd.DataFrame([x for p in parts for x in p])
    out = pd.concat(p7.search(iter([flat.iloc[i : i + 17] for i in range(0, len(flat), 17)])))
    assert built == [30, 30, 30, 9] and set(out["node"]) == set(flat["node"]) - {5000} and out.groupby(["node", "other"]).size().max() == 1


def test_graph_recall():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order, sizes = hnsw.level_order(np.arange(3000))
    x = x[order]
    a, _ = hnsw.Graph(x, sizes).search(x[:300], 6)
    best = np.argsort(-(x[:300] @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(p) & set(q)) / 6 for p, q in zip(a, best)]) >= 0.9
    for n in (1, 2, 5, 97):
        order, sizes = hnsw.level_order(np.arange(n))
        assert hnsw.Graph(x[:n][order], sizes).search(x[:n], 3)[0].shape[0] == n


# 8


def test_tree_encoding_is_the_plain_encoding():
    r = random.Random(6)
    pool = "ab 'st\n\n  \t lre1\u0663é👩\u200d.,!d\u00ad<|endoftext|>Ж"
    for _ in range(1500):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 50)))
        for size in (1, 2, 7):
            ids = p8.encode_tree(PATH, text, size=size).ids if text else []
            assert ids == p8.encode(PATH, [text])[0], (size, text)
        assert p8.decode_tree(PATH, ids) == text.encode()


def test_join_is_associative():
    text = "It's  the\n\n  charters' re-use.   " * 4
    cuts = [0, 7, 31, 64, len(text)]
    a, b, c, e = (p8.leaf(PATH, text, x, y) for x, y in zip(cuts, cuts[1:]))
    j = lambda x, y: p8.join(PATH, text, x, y)
    assert j(j(j(a, b), c), e) == j(a, j(b, j(c, e))) == j(j(a, b), j(c, e))


def test_ids(spark, write):
    long = "word and, \n more " * 20_000
    d = write({"documents": [{"doc_id": 1, "text": None}, {"doc_id": 2, "text": ""}, {"doc_id": 3, "text": long}, {"doc_id": None, "text": "x"}, {"doc_id": 4, "text": "hi"}, {"doc_id": 4, "text": "hi"}]}, CLASH)
    got = {r["doc_id"]: r["ids"] for r in p8.p8_ids(spark, d).collect()}
    assert got[1] == got[2] == [] and got[3] == p8.encode(PATH, [long])[0] and p8.p8_ids(spark, d).count() == 6
    r = p8.p8_roundtrip(spark, d).first()
    assert r["n_docs"] == r["n_exact"] == 6


# 9


def test_packing(spark):
    r = random.Random(7)
    sizes = [(i, r.choice([0, 1, 7, 7, 7, 300, 1024, 2047, 2048, 2049, 5000])) for i in range(3000)] + [(None, 5), (1, 7), (1, 7), (-1, None)]
    out = p9.packed(spark.createDataFrame(sizes, "doc_id long, n_tokens long")).toPandas()
    total = sum(n or 0 for _, n in sizes)
    assert out["n_tokens"].sum() == total and out["container_id"].nunique() <= 1.02 * -(-total // 2048) + 1
    assert out.groupby("container_id")["n_tokens"].sum().max() <= 2048
    inside = out[out["n_tokens"] > 0]
    assert (inside["position"] // inside["tier"] == (inside["position"] + inside["n_tokens"] - 1) // inside["tier"]).all()  # no document lies in two windows
    s = out[out["n_tokens"] > 0].sort_values(["container_id", "position"])
    same = s["container_id"] == s["container_id"].shift()
    assert not (same & (s["position"] < (s["position"] + s["n_tokens"]).shift())).any()
    cut = out.merge(out.groupby("doc_id").size().rename("k"), on="doc_id")
    assert not ((cut["k"] > 1) & (cut["doc_id"] > 1)).any() or cut[(cut["k"] > 1) & (cut["doc_id"] > 1)]["doc_id"].isin([i for i, n in sizes if n and n > 2048]).all()


def test_plan_uses_every_document_once():
    r = random.Random(8)
    for _ in range(60):
        cap = r.randint(5, 60)
        hist = {s: r.randint(1, 40) for s in r.sample(range(1, cap + 1), r.randint(1, min(8, cap)))}
        made = p9.tiered(hist, cap, r.randint(1, 4))
        assert made.rows.groupby("size")["count"].sum().to_dict() == hist
        used, room = {}, {}
        for x in made.rows.itertuples():
            for k in range(x.count):
                tier, window = x.tier, x.base + k // x.each
                (c,), (start,) = made.windows(np.array([tier]), np.array([window]))
                used[c, start] = used.get((c, start), 0) + x.size
                room[c, start] = made.widths[tier]
        assert all(used[w] <= room[w] for w in used) and {c for c, _ in used} == set(range(made.containers))
        for c in range(made.containers):  # windows of a container lie side by side
            own = sorted((s, room[k, s]) for k, s in used if k == c)
            assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= cap


def test_tiers_decide():
    """Documents of one tier share its windows; with one tier the plan is another, and both meet the lower bound where there are short documents to fill gaps."""
    r = random.Random(9)
    hist = {s: r.randint(1, 30) for s in range(1, 2049, 7)}
    hist |= {s: 400 for s in range(1, 40)}
    least = -(-sum(s * n for s, n in hist.items()) // 2048)
    four, one = p9.plan(hist, 2048, 4), p9.plan(hist, 2048, 1)
    assert len(p9.plan({300: 1000}, 2048, 4).widths) == 2  # six to a container, which windows of 512 would not hold
    assert not four.rows.equals(one.rows) and len([n for n in four.whole if n]) > 1 and max(four.containers, one.containers) <= least + 2


# 10


def brute_cover(s):
    n = len(s)
    out = []
    for i in range(n):
        best = 0
        for k in range(1, i + 2):
            sub = s[i - k + 1 : i + 1]
            if sum(s[j : j + k] == sub for j in range(n - k + 1)) < 2:
                break
            best = k
        out.append(best)
    return out


def test_suffix_automaton_against_brute_force():
    r = random.Random(9)
    for _ in range(200):
        s = [r.choice("abc") for _ in range(r.randint(0, 25))]
        assert p10.deepest_repeats(np.array([ord(c) for c in s], np.int64), np.zeros(len(s), np.int64)).tolist() == brute_cover(s), s
    many = [[r.choice("ab") for _ in range(r.randint(0, 12))] for _ in range(40)]  # documents of a batch don't see each other
    got = p10.deepest_repeats(np.array([ord(c) for s in many for c in s], np.int64), np.repeat(np.arange(40), [len(s) for s in many]))
    assert got.tolist() == [x for s in many for x in brute_cover(s)]


def test_symbols_and_batches(monkeypatch):
    text = "Une  été_à 12,5 % — ΑΒΓ x²\n"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts, ends, ids = p10.symbols_of(codes, np.zeros(len(text), np.int64))
    assert [text[a:b] for a, b in zip(starts, ends)] == ["Une", "été", "_", "à", "12", ",", "5", "%", "—", "ΑΒΓ", "x²"] and ids[4] == ids[6] and len(set(ids.tolist())) == 10
    whole = p10.features(SPAM + HAM + ["", "one", "SPAM spam"])
    monkeypatch.setattr(p10, "BATCH", 1)
    assert p10.features(SPAM + HAM + ["", "one", "SPAM spam"]) == whole


SPAM = ["buy essay, cheap essay, essay help, buy essay, " * 12, "\n".join(f"https://shop.example/essay-{i}" for i in range(20)), " ".join(f"#essay_help{i} #cheap_essay" for i in range(20)), "Buy essay template. Cheap essay help! Top essay template!! " * 6]
HAM = ["The survey of the harvest describes an early account of the province and its courts. A second reading contradicts the ledger kept by the clerks of the town.", "References\n" + "\n".join(f"Lo, {c}. (19{i}0). On the charter of {c} towns. Ostrava: Press." for i, c in enumerate("ABCDEFG", 1)), "Contents\n" + "\n".join(f"{i}. On the map of the towns ........ {i * 7}" for i in range(1, 12)), "Index\n" + "\n".join(f"map, {i}, {i + 3}–{i + 9}" for i in range(20)), "O come back to the river where the old songs are sung again tonight.\n\n" * 6]


def test_stuffing(spark, write):
    docs = [{"doc_id": i, "text": t} for i, t in enumerate(SPAM + HAM)] + [{"doc_id": 50, "text": None}, {"doc_id": 51, "text": ""}, {"doc_id": 52, "text": "essay essay"}, {"doc_id": None, "text": SPAM[0]}, {"doc_id": 53, "text": SPAM[0] * 400}]
    d = write({"documents": docs + docs[:2]}, CLASH)
    assert rows(p10.p10_found(spark, d)) == [(0,), (1,), (2,), (3,), (53,)]
    assert p10.p10_scores(spark, d).count() == len(SPAM + HAM) + 3
