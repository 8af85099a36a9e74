"""Problem 2: references to records that are missing, removed or imported only later.

Parent names are hashed into a broadcast Bloom filter of bounded size (operators.bloom). What it denies is a
definite orphan at once; only what it lets through is verified by an exact join, with hot names salted.

A reference is null or empty: none. A target that is a web or mail address: none. A link without imported_at is
never late, one of a note without imported_at neither. Re-delivered rows count once. Several records under one name: it is
removed if all are, late if the first import of any of them is after the link; removed goes before late. Empty tables
give no rows; without parents every reference is missing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, table
from ..skew import skew_join
from . import bloom

ADDRESS = re.compile(r"\s*(?:[a-z][a-z0-9+.\-]*://|//|mailto:|tel:|www\.|[^\s/@\\]+@[^\s/@\\]+\.(?!md\s*$)[a-z]{2,}\s*$)", re.I)
#: The seed of Spark's xxhash64.
SEED = 42


def name_key(value: str) -> str:
    """The spelling all names of a record share: composition, case, blanks, slashes, a leading / or ./ and .md make no difference."""
    v = unicodedata.normalize("NFC", value).replace("\\", "/").replace("%20", " ").strip()
    while v.startswith(("/", "./")):
        v = v[v.index("/") + 1:]
    v = unicodedata.normalize("NFC", v.casefold()).strip()
    return v[:-3] if v.endswith(".md") else v


def _suffixes(path: str) -> list[str]:
    parts = name_key(path).split("/")
    return ["/".join(parts[i:]) for i in range(len(parts))]


def parents(notes: DataFrame, assets: DataFrame) -> DataFrame:
    """(key, kept, first_at, is_asset): every name a record goes by. key begins with `i:` (note id) or `t:` (name)."""
    newest = F.struct("imported_at", F.col("removed_at").isNotNull().alias("removed"), "relative_path", "filename", "aliases_json")
    one = notes.filter("note_id IS NOT NULL").groupBy("note_id").agg(F.max(newest).alias("r"), F.min("imported_at").alias("first_at"))
    one = one.select("note_id", F.col("r.removed").alias("removed"), "first_at", F.col("r.relative_path").alias("path"), F.col("r.filename").alias("filename"), F.from_json("r.aliases_json", "array<string>").alias("aliases"))
    files = assets.select(F.lit(None).cast("string").alias("note_id"), F.lit(False).alias("removed"), F.lit(None).cast("timestamp").alias("first_at"), F.col("relative_path").alias("path"), "filename", F.lit(None).cast("array<string>").alias("aliases")).withColumn("is_asset", F.lit(True))

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for i, (note, path, filename, aliases) in enumerate(zip(f["note_id"], f["path"], f["filename"], f["aliases"])):
                names = {n for p in (path, filename) if p for n in _suffixes(p)}
                names |= {name_key(a) for a in (aliases if aliases is not None else ()) if a}
                out += [(i, f"t:{n}") for n in names if n]
                if note:
                    out.append((i, f"i:{note}"))
            at = [i for i, _ in out]
            yield pd.DataFrame({"key": [k for _, k in out], "kept": ~f["removed"].to_numpy(bool)[at], "first_at": f["first_at"].to_numpy()[at], "is_asset": f["is_asset"].to_numpy(bool)[at]})

    rows = one.withColumn("is_asset", F.lit(False)).unionByName(files).mapInPandas(named, "key string,kept boolean,first_at timestamp,is_asset boolean")
    return rows.groupBy("key").agg(F.max("kept").alias("kept"), F.min("first_at").alias("first_at"), F.max("is_asset").alias("is_asset"))


def orphans(links: DataFrame, notes: DataFrame, assets: DataFrame) -> DataFrame:
    """(link_id, ref_field, state, imported_at), one row per orphan reference."""
    known = cut(parents(notes, assets).withColumn("h", F.xxhash64("key")))
    words = bloom.build(known, "h", known.count())
    shared = links.sparkSession.sparkContext.broadcast(words)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            keys, at, fields = [], [], []
            for i, (note, target) in enumerate(zip(f["note_id"], f["target"])):
                if note and note.strip():
                    keys.append(f"i:{note}")
                    at.append(i)
                    fields.append("note_id")
                if target and not ADDRESS.match(target) and (k := name_key(target)):
                    keys.append(f"t:{k}")
                    at.append(i)
                    fields.append("target")
            h = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))
            likely = np.ones(len(keys), bool) if shared.value is None else bloom.might_contain(shared.value, h)
            yield pd.DataFrame({"link_id": f["link_id"].to_numpy()[at], "ref_field": fields, "key": keys, "imported_at": f["imported_at"].to_numpy()[at], "likely": likely})

    refs = links.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("link_id"), "note_id", "target", "imported_at").mapInPandas(probe, "link_id bigint,ref_field string,key string,imported_at timestamp,likely boolean")
    refs = cut(refs)
    certain = refs.filter("NOT likely").select("link_id", "ref_field", F.lit("missing").alias("state"), "imported_at")
    checked = skew_join(refs.filter("likely").drop("likely"), known.select("key", "kept", "first_at", "is_asset"), ["key"], "left")
    state = F.when(F.col("kept").isNull(), "missing").when(~F.col("kept"), "removed").when(~F.col("is_asset") & (F.col("first_at") > F.col("imported_at")), "late")
    # first_at is a column of either side's own; the link's is imported_at.
    verified = checked.select("link_id", "ref_field", state.alias("state"), "imported_at").filter("state IS NOT NULL")
    return certain.unionByName(verified).distinct()


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(*(table(spark, sf_dir, t) for t in ("obsidian_links", "obsidian_notes", "obsidian_assets")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("link_id", "ref_field", "state").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per reference field, month of imported_at and state."""
    month = F.date_format("imported_at", "yyyy-MM").alias("month")
    return _orphans(spark, sf_dir).groupBy(F.lit("obsidian_links").alias("source_table"), "ref_field", month, "state").agg(F.count_distinct("link_id").alias("n_links"))


_KEY = r"""regexp_replace(regexp_replace(trim(nfc_normalize(lower(regexp_replace(trim(replace(replace({x}, '\', '/'), '%20', ' ')), '^(\./|/)+', '')))), '\.md$', ''), '^$', '')"""


def _sql(final: str) -> str:
    k = lambda x: _KEY.replace("{x}", x)
    return f"""
WITH newest AS (
  SELECT note_id, arg_max(removed_at IS NOT NULL, imported_at) AS removed, min(imported_at) AS first_at,
         arg_max(relative_path, imported_at) AS path, arg_max(aliases_json, imported_at) AS aliases
  FROM (SELECT DISTINCT note_id, imported_at, removed_at, relative_path, aliases_json FROM obsidian_notes) GROUP BY note_id),
parts AS (
  SELECT note_id, removed, first_at, false AS is_asset, string_split({k('path')}, '/') AS p FROM newest
  UNION ALL SELECT NULL, false, NULL, true, string_split({k('relative_path')}, '/') FROM obsidian_assets),
names AS (
  SELECT 't:' || array_to_string(p[i:], '/') AS key, removed, first_at, is_asset FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts)
  UNION ALL SELECT 't:' || {k('a')}, removed, first_at, false FROM (SELECT *, unnest(from_json(aliases, '["VARCHAR"]')) AS a FROM newest)
  UNION ALL SELECT 'i:' || note_id, removed, first_at, false FROM newest),
known AS (SELECT key, bool_or(NOT removed) AS kept, min(first_at) AS first_at, bool_or(is_asset) AS is_asset FROM names GROUP BY key),
refs AS (
  SELECT id AS link_id, 'note_id' AS ref_field, 'i:' || note_id AS key, imported_at FROM obsidian_links WHERE trim(note_id) <> ''
  UNION ALL SELECT id, 'target', 't:' || {k('target')}, imported_at FROM obsidian_links
  WHERE {k('target')} <> '' AND NOT regexp_matches(lower(target), '^\\s*([a-z][a-z0-9+.-]*://|mailto:|tel:|www\\.)')),
found AS (
  SELECT DISTINCT link_id, ref_field, imported_at, CASE WHEN kept IS NULL THEN 'missing' WHEN NOT kept THEN 'removed'
    WHEN NOT is_asset AND known.first_at > imported_at THEN 'late' END AS state
  FROM refs LEFT JOIN known USING (key))
{final}"""


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": _sql("SELECT DISTINCT link_id, ref_field, state FROM found WHERE state IS NOT NULL").replace("\\\\", "\\"),
    "p2_report": _sql("SELECT 'obsidian_links' AS source_table, ref_field, strftime(imported_at, '%Y-%m') AS month, state, count(DISTINCT link_id) AS n_links FROM found WHERE state IS NOT NULL GROUP BY ALL").replace("\\\\", "\\"),
}
