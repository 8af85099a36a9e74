"""Orphan references, hierarchies, skewed joins and the Bloom filter on small cases with brute force."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import bloom, hierarchy as H, orphans as O
from lectern.operators.resolve import global_rank
from lectern.skew import skew_join

DAY = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
CLASH = "key state h kept likely n id_ ptr ids names lost"


def test_orphan_states(spark, write):
    note = lambda i, path, at, removed=None, aliases="[]": {"note_id": i, "relative_path": path, "filename": path.split("/")[-1], "aliases_json": aliases, "imported_at": DAY(at), "removed_at": removed}
    notes = [note("a", "X/Y/Résumé one.md", 5, aliases='["On one"]'), note("b", "Z/two.md", 5), note("b", "Z/two.md", 9, DAY(9)), note("c", "late.md", 50)]
    notes += notes[:2]
    targets = ["résumé ONE", "Y/Résumé%20one.md", "./X/Y/Résumé one", "X\\Y\\Résumé one.md", " on one ", "two", "late", "gone", "https://x.example/1", "mailto:a@b.example", "", None, "img/p.png", "p.PNG", "Q/two.md"]
    links = [{"id": i, "note_id": "a", "target": t, "imported_at": DAY(20)} for i, t in enumerate(targets)]
    links += [{"id": 100, "note_id": "zz", "target": "two", "imported_at": DAY(20)}, {"id": 101, "note_id": None, "target": None, "imported_at": None}, {"id": None, "note_id": "zz", "target": "q", "imported_at": DAY(1)}, {"id": 102, "note_id": "c", "target": "late", "imported_at": None}]
    links += links[:3]
    d = write({"obsidian_notes": notes, "obsidian_links": links, "obsidian_assets": [{"relative_path": "a/img/p.png", "filename": "p.png"}]}, CLASH)
    got = sorted(map(tuple, O.p2_found(spark, d).collect()))
    assert got == [(5, "target", "removed"), (6, "target", "late"), (7, "target", "missing"), (14, "target", "missing"), (100, "note_id", "missing"), (100, "target", "removed")]
    assert O.p2_report(spark, d).count() > 0


def test_orphans_of_empty_tables(spark, write):
    d = write({})
    assert O.p2_found(spark, d).count() == 0
    d = write({"obsidian_links": [{"id": 1, "note_id": "a", "target": "b", "imported_at": DAY(1)}]})
    assert sorted(map(tuple, O.p2_found(spark, d).collect())) == [(1, "note_id", "missing"), (1, "target", "missing")]


def test_hierarchy_against_brute_force(spark, write):
    r = random.Random(3)
    parent = {i: r.choice([None, *range(1, 60), 999]) if i % 7 else None for i in range(1, 60)}
    parent |= {100: 100, **{200 + i: 200 + i - 1 if i else None for i in range(70)}}  # its own parent; a deep chain
    rows = [{"collection_id": i, "name": f"n / {i % 5}" if i % 3 else None, "parent_id": p} for i, p in parent.items()]
    d = write({"zotero_collections": rows + rows[:5] + [{"collection_id": None, "name": "x", "parent_id": 1}]}, CLASH)
    got = {x["collection_id"]: x for x in H.p4_hierarchy(spark, d).collect()}
    assert len(got) == len(parent)
    name = {x["collection_id"]: x["name"] or "" for x in rows}
    pairs = set()
    for i in parent:
        path, at = [i], parent[i]
        while at is not None and at in parent and at not in path:
            path.append(at)
            at = parent[at]
        status = "rooted" if at is None else "lost_parent" if at not in parent else "cycle" if at == i else "below_cycle"
        assert got[i]["status"] == status, i
        if status == "rooted":
            assert got[i]["path"] == " / ".join(name[x] for x in reversed(path)) and got[i]["depth"] == len(path) - 1 and got[i]["root_id"] == path[-1]
            pairs |= {(a, i) for a in path}
    assert {tuple(x) for x in H.p4_descendants(spark, d).collect()} == pairs
    found = {tuple(x) for x in H.p4_found(spark, d).collect()}
    assert (100, "cycle") in found and (200, "path") in found and (200, "depth") in found and (200, "descendants") in found


def test_hierarchy_found_nothing_where_stored_is_right(spark, write):
    d = write({"zotero_collections": [{"collection_id": 1, "name": "a", "parent_id": None, "path": "a", "depth": 0}, {"collection_id": 2, "name": "b", "parent_id": 1, "path": "a / b", "depth": 1}], "collection_descendants": [{"ancestor_id": a, "descendant_id": b} for a, b in ((1, 1), (1, 2), (2, 2), (2, 2))]})
    assert H.p4_found(spark, d).count() == 0
    assert H.p4_found(spark, write({})).count() == 0


def test_skew_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    right = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, skew_join(left, right, ["k"], how, rows_per_salt=100).collect()))
        assert a == sorted(map(str, left.join(right, ["k"], how).collect())), how


def test_bloom_denies_no_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    words = bloom.build(keys, "h", 5000)
    own = np.array([r["h"] for r in keys.collect()], np.int64).view(np.uint64)
    assert bloom.might_contain(words, own).all()
    other = np.array([r[0] for r in spark.range(10_000, 20_000).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    assert bloom.might_contain(words, other).mean() < 0.05
    assert bloom.build(keys, "h", bloom.MAX_KEYS + 1) is None


def test_global_rank(spark):
    got = global_rank(spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")), ["x"], "n").collect()
    assert all(r["n"] == r["x"] + 1 for r in got)
