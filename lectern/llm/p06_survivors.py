"""Problem 6: one surviving record per item.

Skyline: records of an item are compared in trust (annotations), recency order (earlier date_added first, then smaller id)
and completeness (number of real fields). Records are reduced to the first of each (trust, completeness) level by a partial aggregate, which loses no undominated
record. Then the levels are sorted by recency and filtered: a level stands on the skyline if its trust is above all trust seen before it at its completeness or a higher one.
Each level is laid out for its own completeness and all lower ones, so this is a running maximum in a window that spills and streams, without comparing pairs.
The skyline's lexicographic first (trust, date, id) is the representative.

Filling: in filling, a record dominates another if it comes earlier and has all its real fields. Records with the same set of real fields are reduced to the
first one by a partial aggregate, so of an item at most one record for each set meets, however many it has. The order of filling (representative, then recency) puts these
into layers of one record each, and the layers are gone through from the first on, each filling the fields that are still empty.

Defined cases: null annotation_count is 0; a date that is null or can't be read comes last; of several loads of one source record the newest
loaded_at holds (ties: the largest by value); null or unreadable metadata has no fields; values that are blank, without letter or digit or only
stand for "nothing known" aren't real; records without item_id or source_item_id are left out; items with one source have no rows in p6_found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut, table

# What stands for "nothing known", in lower case without punctuation and blanks.
EMPTY_VALUES = ["na", "none", "null", "nil", "nan", "unknown", "notavailable", "notknown", "undefined", "missing", "sn", "sl", "sd", "nd", "tbd", "tba"]


def real(value: Column) -> Column:
    bare = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")
    return value.isNotNull() & (bare != "") & ~bare.isin(EMPTY_VALUES)


def instant(text: Column) -> Column:
    """Microseconds of a date notation; without an offset it is UTC."""
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(Z|[+-]\d\d:?\d\d)$") & t.rlike(r"\d:\d\d"), t).when(t.rlike(r":\d\d"), F.concat(t, F.lit("Z"))).otherwise(F.concat(t, F.lit("T00:00:00Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


CELLS = "array<struct<key:string,value:string>>"


def sources(df: DataFrame) -> DataFrame:
    """The source records as last loaded: item_id, sid, trust, late (no date), at, cells (real fields by name)."""
    newest = F.max(F.struct("loaded_at", "date_added", "annotation_count", "metadata_json")).alias("r")
    one = df.filter("item_id IS NOT NULL AND source_item_id IS NOT NULL").groupBy("item_id", F.col("source_item_id").alias("sid")).agg(newest)
    fields = F.map_filter(F.from_json("r.metadata_json", "map<string,string>"), lambda k, v: real(v))
    cells = F.coalesce(F.array_sort(F.map_entries(fields)), F.array().cast(CELLS))
    at = instant(F.col("r.date_added"))
    return one.select("item_id", "sid", F.coalesce("r.annotation_count", F.lit(0)).cast("long").alias("trust"), at.isNull().alias("late"), F.coalesce(at, F.lit(0)).alias("at"), cells.alias("cells"))


def skyline(src: DataFrame) -> DataFrame:
    """(item_id, sid, trust, late, at, complete, cells): the undominated records of each item."""
    first = F.min(F.struct("late", "at", "sid", "cells")).alias("o")
    levels = src.groupBy("item_id", "trust", F.size("cells").alias("complete")).agg(first)
    own = F.col("c") == F.col("complete")
    laid = levels.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("complete")))).select("item_id", "trust", "complete", "c", "o.late", "o.at", "o.sid", F.when(own, F.col("o.cells")).alias("cells"))
    before = F.max("trust").over(Window.partitionBy("item_id", "c").orderBy("late", "at", "sid").rowsBetween(Window.unboundedPreceding, -1))
    front = laid.withColumn("before", before).filter(own & (F.col("before").isNull() | (F.col("trust") > F.col("before"))))
    return front.select("item_id", "sid", "trust", "late", "at", "complete", "cells")


def representatives(sky: DataFrame) -> DataFrame:
    """(item_id, sid, cells): the lexicographic policy over the skyline."""
    best = F.min(F.struct((-F.col("trust")).alias("t"), "late", "at", "sid", "cells")).alias("b")
    return sky.groupBy("item_id").agg(best).select("item_id", "b.sid", "b.cells")


def layers(src: DataFrame, reps: DataFrame) -> DataFrame:
    """(item_id, sid, n_sources, layers): the representative's record, then the first record with each set of real fields, by recency; sid: the representative."""
    names = F.transform("cells", lambda x: x["key"])
    shapes = src.groupBy("item_id", names.alias("names")).agg(F.min(F.struct("late", "at", "sid", "cells")).alias("o"), F.count(F.lit(1)).alias("n"))
    met = shapes.groupBy("item_id").agg(F.array_sort(F.collect_list("o")).alias("all"), F.sum("n").alias("n_sources"))
    one = lambda sid, cells: F.struct(sid.alias("sid"), cells.alias("cells"))
    joined = reps.join(met, "item_id")
    return joined.select("item_id", "sid", "n_sources", F.concat(F.array(one(F.col("sid"), F.col("cells"))), F.transform("all", lambda o: one(o["sid"], o["cells"]))).alias("layers"))


def filled(stacked: DataFrame) -> DataFrame:
    """(item_id, field_name, sid, value, n_sources) of every field for which some record has a real value: from the first layer that has one."""

    def fill(done: Column, layer: Column) -> Column:
        known = F.transform(done, lambda x: x["field_name"])
        new = F.filter(layer["cells"], lambda x: ~F.array_contains(known, x["key"]))
        return F.concat(done, F.transform(new, lambda x: F.struct(x["key"].alias("field_name"), layer["sid"].alias("sid"), x["value"].alias("value"))))

    empty = F.array().cast("array<struct<field_name:string,sid:bigint,value:string>>")
    return stacked.select("item_id", "n_sources", F.explode(F.aggregate("layers", empty, fill)).alias("x")).select("item_id", "x.*", "n_sources")


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    src = cut(sources(table(spark, sf_dir, "item_sources")))
    return src, skyline(src)


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, sky = _parts(spark, sf_dir)
    return cut(layers(src, representatives(sky)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = _stacked(spark, sf_dir).filter("n_sources > 1")
    whole = many.select("item_id", F.lit("*").alias("field_name"), F.col("sid").alias("source_item_id"))
    return whole.unionByName(filled(many).select("item_id", "field_name", F.col("sid").alias("source_item_id")))


def p6_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The undominated source records of each item, with the dimensions they were compared in."""
    return _parts(spark, sf_dir)[1].select("item_id", F.col("sid").alias("source_item_id"), F.col("trust").alias("annotation_count"), F.col("complete").alias("n_real_fields"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items with canonical_source_item_id and metadata_json set right: the survivor's id, and every field from the record it is taken from, as JSON in the order of names. Items without source records keep what they have; of repeated rows with other content the smallest by value counts."""
    stacked = _stacked(spark, sf_dir)
    cells = filled(stacked).groupBy("item_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "value"))))).alias("metadata"))
    fixed = stacked.select("item_id", "sid").join(cells, "item_id", "left").withColumnRenamed("item_id", "id").withColumn("has", F.lit(True))
    columns = ["canonical_source_item_id", "metadata_json", "title", "item_type"]
    items = table(spark, sf_dir, "items").groupBy("id").agg(F.min(F.struct(*columns)).alias("r")).select("id", "r.*")
    has = F.coalesce("has", F.lit(False))
    return items.join(fixed, "id", "left").select("id", F.when(has, F.col("sid")).otherwise(F.col("canonical_source_item_id")).alias("canonical_source_item_id"), F.when(has, F.coalesce("metadata", F.lit("{}"))).otherwise(F.col("metadata_json")).alias("metadata_json"), "title", "item_type")


_REAL = "list_contains([" + ",".join(f"'{v}'" for v in ["", *EMPTY_VALUES]) + "], regexp_replace(lower(value), '[^\\p{L}\\p{N}]+', '', 'g')) = false"
_BASE = f"""
WITH s AS (
  SELECT item_id, source_item_id AS sid, coalesce(annotation_count, 0) AS trust, metadata_json,
    CASE WHEN regexp_matches(date_added, '(Z|[+-]\\d\\d:?\\d\\d)$') AND date_added LIKE '%:%' THEN try_cast(date_added AS TIMESTAMPTZ) ELSE try_cast(date_added || 'Z' AS TIMESTAMPTZ) END AS at_,
    row_number() OVER (PARTITION BY item_id, source_item_id ORDER BY loaded_at DESC) AS rn
  FROM (SELECT DISTINCT * FROM item_sources) QUALIFY rn = 1),
rep AS (
  SELECT item_id, sid FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY trust DESC, at_ ASC NULLS LAST, sid) = 1),
many AS (SELECT item_id FROM s GROUP BY item_id HAVING count(*) > 1),
cells AS (
  SELECT s.item_id, s.sid, s.at_, k AS field_name, json_extract_string(metadata_json, '$."' || k || '"') AS value
  FROM (SELECT *, unnest(json_keys(metadata_json)) AS k FROM s WHERE metadata_json IS NOT NULL) s),
picked AS (
  SELECT c.item_id, c.field_name, c.sid, c.value FROM cells c JOIN rep USING (item_id) WHERE value IS NOT NULL AND {_REAL}
  QUALIFY row_number() OVER (PARTITION BY c.item_id, field_name ORDER BY c.sid <> rep.sid, c.at_ ASC NULLS LAST, c.sid) = 1)
"""
QUERIES = {"p6_found": p6_found, "p6_skyline": p6_skyline, "p6_items": p6_items}
SQL = {
    "p6_items": _BASE + """, m AS (SELECT item_id, '{' || string_agg(to_json(field_name)::VARCHAR || ':' || to_json(value)::VARCHAR, ',' ORDER BY field_name) || '}' AS metadata FROM picked GROUP BY item_id)
SELECT i.id, coalesce(rep.sid, canonical_source_item_id) AS canonical_source_item_id, CASE WHEN rep.sid IS NULL THEN metadata_json ELSE coalesce(m.metadata, '{}') END AS metadata_json, title, item_type
FROM (SELECT DISTINCT id, canonical_source_item_id, metadata_json, title, item_type FROM items) i LEFT JOIN rep ON rep.item_id = i.id LEFT JOIN m ON m.item_id = i.id""",
    "p6_found": _BASE + "SELECT item_id, '*' AS field_name, sid AS source_item_id FROM rep JOIN many USING (item_id) UNION ALL SELECT item_id, field_name, sid FROM picked JOIN many USING (item_id)",
    "p6_skyline": _BASE + f""", p AS (SELECT s.item_id, s.sid, trust, at_, (SELECT count(*) FROM cells c WHERE c.item_id = s.item_id AND c.sid = s.sid AND value IS NOT NULL AND {_REAL}) AS n FROM s)
SELECT item_id, sid AS source_item_id, trust AS annotation_count, n AS n_real_fields FROM p WHERE NOT EXISTS (
  SELECT 1 FROM p q WHERE q.item_id = p.item_id AND q.trust >= p.trust AND q.n >= p.n AND (coalesce(q.at_, TIMESTAMPTZ '9999-01-01'), q.sid) < (coalesce(p.at_, TIMESTAMPTZ '9999-01-01'), p.sid))""",
}
