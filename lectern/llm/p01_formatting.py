"""Problem 1: records that are the same but for their writing.

Each record is hashed as a stream through the skip-and-fold table (foldhash), fields with their own order:
`text` as it stands; `doi` from the first `10.` on; `names` as a list of (first, last) pairs in order; `parts`
split at `|` in any order; `label` compared exactly. Groups of equal hashes are verified against their smallest id
by the two-pointer comparison; rows that differ from it in spite of equal hashes are hashed under other seeds, grouped and verified again, until none is left.

Nulls equal empty values. Re-delivered rows count once (one row per id; of rows with one id and other content, any
one, the smallest by value). Rows with a null id are left out. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut, spread, table
from ..skew import skew_join
from . import foldhash as H

NAMES = "array<struct<firstName:string,lastName:string,name:string>>"
DOI_START = re.compile(r"1\s*0\s*\.")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"


RECORD = (Field("title"), Field("doi", "doi"), Field("creators_json", "names"), Field("date_created"))
KEY = (Field("match_method", "label"), Field("match_key", "parts"))


def _as_text(f: Field) -> Column:
    """The field as the kernels take it: a string; names as an array of parts (order and number of JSON fields don't matter)."""
    c = F.col(f.name).cast("string")
    if f.kind != "names":
        return F.coalesce(c, F.lit(""))
    some = lambda x: F.coalesce(x, F.lit(""))
    people = F.from_json(c, NAMES)
    return F.when(people.isNull(), F.array(F.coalesce(c, F.lit("")))).otherwise(F.flatten(F.transform(people, lambda p: F.array(some(p["firstName"]), some(p["lastName"]), some(p["name"])))))


def _streams(f: Field, value) -> list[str]:
    """The runs of characters a field consists of."""
    if f.kind == "names":
        return list(value)
    if f.kind == "parts":
        return [v[m.start():] if (m := DOI_START.search(v)) else v for v in value.split("|")]
    if f.kind == "doi":
        return [value[m.start():] if (m := DOI_START.search(value)) else value]
    return [value]


def record_hash(frame: pd.DataFrame, fields: tuple[Field, ...], seed: int = 0) -> np.ndarray:
    """(rows, 2) int64."""
    total = np.zeros((len(frame), 2), np.uint64)
    for k, f in enumerate(fields):
        texts, rows, places = [], [], []
        for i, value in enumerate(frame[f.name]):
            for j, s in enumerate([value.encode().hex()] if f.kind == "label" else _streams(f, value)):
                if s:
                    texts.append(s)
                    rows.append(i)
                    places.append(0 if f.kind == "parts" else j)
        if not texts:
            continue
        h = H.hash_texts(texts)
        place = np.array(places, np.uint64)
        with np.errstate(over="ignore"):
            for c in range(2):
                x = H.mix(h[:, c] + place * np.uint64(0xD6E8FEB86659FD93), 2 * k + c + 64 * seed)
                x[h.any(1) == 0] = 0  # what is empty under the table says nothing
                np.add.at(total[:, c], np.array(rows), x)
    return total.view(np.int64)


def _same(a, b, fields: tuple[Field, ...]) -> bool:
    for f, x, y in zip(fields, a, b):
        if f.kind == "label":
            if x != y:
                return False
            continue
        p, q = _streams(f, x), _streams(f, y)
        if f.kind == "parts":  # in any order: each finds its own
            p, q = [s for s in p if any(H.stream(s))], [s for s in q if any(H.stream(s))]
            if len(p) != len(q):
                return False
            for s in p:
                hit = next((i for i, t in enumerate(q) if H.same(s, t)), None)
                if hit is None:
                    return False
                q.pop(hit)
            continue
        n = max(len(p), len(q))
        if not all(H.same(s, t) for s, t in zip(p + [""] * (n - len(p)), q + [""] * (n - len(q)))):
            return False
    return True


def copies(df: DataFrame, id_col: str, fields: tuple[Field, ...]) -> DataFrame:
    """(id, class_id) of every record: class_id is the smallest id of the records that say the same."""
    names = [f.name for f in fields]
    slim = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *[_as_text(f).alias(f.name) for f in fields])
    schema = slim.schema.simpleString()[7:-1]

    def hashed(batches: Iterator[pd.DataFrame], seed: int = 0) -> Iterator[pd.DataFrame]:
        for frame in batches:
            h = record_hash(frame, fields, seed)
            yield frame.assign(h1=h[:, 0], h2=h[:, 1])

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = zip(frame["id"], frame["first_id"], zip(*[frame[n] for n in names]), zip(*[frame[f"r_{n}"] for n in names]))
            ok = [i == j or _same(a, b, fields) for i, j, a, b in rows]
            yield frame.assign(ok=ok)[["id", *names, "h1", "h2", "first_id", "ok"]]

    rows = spread(slim).mapInPandas(hashed, f"{schema},h1 bigint,h2 bigint")
    # One row per id: identical re-deliveries collapse before anything is grouped by the hash.
    rows = rows.groupBy("id").agg(F.min(F.struct("h1", "h2", *names)).alias("r")).select("id", "r.*")
    rows = cut(rows)  # read three times below; hashing isn't repeated

    def grouped(rows: DataFrame) -> DataFrame:
        groups = rows.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        first = groups.join(rows.select(F.col("id").alias("first_id"), *[F.col(n).alias(f"r_{n}") for n in names]), "first_id")
        return skew_join(rows, first, ["h1", "h2"], "inner").mapInPandas(verified, f"{schema},h1 bigint,h2 bigint,first_id bigint,ok boolean")

    linked, left, seed = [], rows, 0
    while True:
        once = cut(grouped(left))
        linked.append(once.filter("ok").select("id", F.col("first_id").alias("class_id")))
        if once.filter("NOT ok").isEmpty():
            break
        seed += 1  # the smallest id of each group is settled, so there are fewer every time
        left = once.filter("NOT ok").select("id", *names).mapInPandas(functools.partial(hashed, seed=seed), f"{schema},h1 bigint,h2 bigint")
    linked = functools.reduce(DataFrame.unionByName, linked)
    return rows.select("id").join(linked, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))


SOURCES = (("items", "id", RECORD), ("duplicate_groups", "item_id", KEY))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct record of either table once, by its smallest id, with the number of its copies."""
    parts = [copies(table(spark, sf_dir, t), k, f).groupBy(F.lit(t).alias("source_table"), F.col("class_id").alias("record_id")).agg(F.count(F.lit(1)).alias("n_copies")) for t, k, f in SOURCES]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, key, fields in SOURCES:
        c = copies(table(spark, sf_dir, name), key, fields)
        parts.append(c.filter("id <> class_id").select(F.lit(name).alias("source_table"), F.col("class_id").alias("first_id"), F.col("id").alias("other_id")))
    return parts[0].unionByName(parts[1])


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes}

_S = lambda x: f"regexp_replace(replace(replace(nfc_normalize(lower(nfc_normalize(coalesce({x}, '')))), 'ß', 'ss'), 'ς', 'σ'), '[\\s\\p{{Z}}\\p{{P}}\\p{{C}}\\x{{2044}}]+', '', 'g')"
_DOI = lambda x: _S(f"regexp_replace({x}, '^.*?(1\\s*0\\s*\\.)', '\\1', 's')")
_PEOPLE = "array_to_string(list_transform(from_json(creators_json, '[{\"firstName\":\"VARCHAR\",\"lastName\":\"VARCHAR\"}]'), lambda p: " + _S("p.firstName") + " || '|' || " + _S("p.lastName") + "), ';')"
_RECORDS = f"SELECT 'items' AS t, id, [{_S('title')}, {_DOI('doi')}, {_PEOPLE}, {_S('date_created')}] AS k FROM items"
_KEYS = f"SELECT 'duplicate_groups' AS t, item_id AS id, list_prepend(match_method, list_sort(list_transform(string_split(coalesce(match_key, ''), '|'), lambda x: {_DOI('x')}))) AS k FROM duplicate_groups"
SQL = {
    "p1_found": f"WITH r AS (SELECT DISTINCT * FROM ({_RECORDS} UNION ALL {_KEYS})), g AS (SELECT *, min(id) OVER (PARTITION BY t, k) AS first_id FROM r) SELECT t AS source_table, first_id, id AS other_id FROM g WHERE id <> first_id",
    "p1_classes": f"WITH r AS (SELECT DISTINCT * FROM ({_RECORDS} UNION ALL {_KEYS})) SELECT t AS source_table, min(id) AS record_id, count(*) AS n_copies FROM r GROUP BY t, k",
}
