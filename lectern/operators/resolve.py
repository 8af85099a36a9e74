"""Entity resolution helpers: keys, groups numbered in order, survivors' fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..session import cut, table


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1..n in the order of columns that are unique together, without one task that sees all rows: ranges are sorted apart, and only their sizes reach the driver."""
    s = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["n"]) for r in s.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    start, at = {}, 0
    for p, n in sizes:
        start[p], at = at, at + n
    rn = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    if not start:
        return s.withColumn(name, F.lit(0).cast("long")).drop("_part")
    first = F.element_at(F.create_map(*[F.lit(x) for p in start.items() for x in p]), F.col("_part"))
    return s.withColumn(name, (first + rn).cast("long")).drop("_part")


def dedupe_key(row) -> Column:
    """DOI before ISBN before title, year and first author's last name; all in letters and digits only. Without title, or with neither year nor author, a record stands alone, as a standalone attachment always does.

    row: name of a column -> Column."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    alone = F.concat(F.lit("id:"), row("id").cast("string"))
    doi, isbn, title, year = T.norm_key(row("doi")), T.norm_key(row("isbn")), T.norm_key(row("title")), F.coalesce(T.year(row("date_created")), F.lit(""))
    first = F.try_element_at(F.from_json(row("creators_json"), T.CREATORS), F.lit(1))
    author = F.coalesce(T.norm_key(F.when(some(first["lastName"]), first["lastName"]).otherwise(first["firstName"])), F.lit(""))
    return (
        F.when(row("item_type") == "standaloneAttachment", alone)
        .when(some(doi), F.concat(F.lit("doi:"), doi))
        .when(some(isbn), F.concat(F.lit("isbn:"), isbn))
        .when(some(title) & ((year != "") | (author != "")), F.concat_ws("|", F.concat(F.lit("title:"), title), year, author))
        .otherwise(alone)
    )


def universe(items: DataFrame, attachments: DataFrame, deleted: DataFrame) -> DataFrame:
    """items (id, item_type, ...) that aren't deleted and are records of their own, and each attachment (id, parent_id, ...) without parent that isn't deleted as a record with the negative id."""
    own = items.filter(~F.coalesce(F.col("item_type").isin("attachment", "note", "annotation"), F.lit(False))).join(deleted.select("id"), "id", "left_anti")
    alone = attachments.filter("parent_id IS NULL").join(deleted.select("id"), "id", "left_anti").drop("parent_id")
    return own.unionByName(alone.withColumn("id", -F.col("id")).withColumn("item_type", F.lit("standaloneAttachment")), allowMissingColumns=True)


def item_universe(spark: SparkSession, d: str) -> DataFrame:
    """The records of items, and notes without item as standalone ones. The tables name no deleted rows: ids matched by ISBN stand in for them."""
    items = table(spark, d, "items").select("id", "item_type", "title").distinct()
    notes = table(spark, d, "notes").select("id", F.col("item_id").alias("parent_id"), "title").distinct()
    deleted = table(spark, d, "duplicate_groups").filter("match_method = 'isbn'").select(F.col("item_id").alias("id")).distinct()
    return universe(items, notes, deleted)


def entity_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per key; entities are numbered by their smallest record. No transitive closure."""
    i = table(spark, d, "items").select("id", dedupe_key(F.col).alias("k")).distinct()
    g = i.groupBy("k").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return global_rank(g, ["first_id"], "entity_id")


def unified_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of each entity: those of its records in the order of their ids, each once."""
    i = table(spark, d, "items").distinct().select("id", dedupe_key(F.col).alias("k"), F.from_json("tags_json", "array<string>").alias("tags"))
    one = i.select("k", "id", F.posexplode("tags").alias("pos", "tag")).groupBy("k", "tag").agg(F.min(F.struct("id", "pos")).alias("first"))
    return one.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))), lambda x: x["tag"]), ",").alias("tags"))


def enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Notes with a bad title get that of their item: (id, title, enriched)."""
    n = table(spark, d, "notes").select("id", "item_id", "title").distinct()
    i = table(spark, d, "items").select(F.col("id").alias("item_id"), F.col("title").alias("item_title")).distinct()
    bad = T.bad_title(F.col("title"))
    return n.join(i, "item_id", "left").select("id", F.when(bad & F.col("item_title").isNotNull(), F.col("item_title")).otherwise(F.col("title")).alias("title"), (bad & F.col("item_title").isNotNull()).alias("enriched"))


QUERIES = {"item_universe": item_universe, "entity_groups": entity_groups, "unified_tags": unified_tags, "metadata_enrichment": enrichment}
_N = lambda x: f"regexp_replace(strip_accents(replace(replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl')), '[^a-z0-9]+', '', 'g')"
_FIRST = "from_json(creators_json, '[{\"firstName\":\"VARCHAR\",\"lastName\":\"VARCHAR\"}]')[1]"
_AUTHOR = _N(f"coalesce(nullif({_FIRST}.lastName, ''), {_FIRST}.firstName)")
_YEAR = "coalesce(regexp_extract(date_created, '(1[89]\\d\\d|2[01]\\d\\d)', 1), '')"
_KEY = f"CASE WHEN {_N('doi')} <> '' THEN concat('doi:', {_N('doi')}) WHEN {_N('isbn')} <> '' THEN concat('isbn:', {_N('isbn')}) WHEN {_N('title')} <> '' AND ({_YEAR} <> '' OR {_AUTHOR} <> '') THEN concat('title:', {_N('title')}, '|', {_YEAR}, '|', {_AUTHOR}) ELSE concat('id:', id::VARCHAR) END"
_T = "trim(regexp_replace(regexp_replace(n.title, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ._-')"
_BAD = f"coalesce({_T} = '' OR regexp_matches({_T}, '{T.GENERIC_TITLE}') OR lower({_T}) LIKE '%.pdf', true)"
_GONE = "SELECT item_id FROM duplicate_groups WHERE match_method = 'isbn'"
SQL = {
    "item_universe": f"SELECT DISTINCT id, item_type, title FROM items WHERE (item_type IS NULL OR item_type NOT IN ('attachment', 'note', 'annotation')) AND id NOT IN ({_GONE}) UNION ALL SELECT DISTINCT -id, 'standaloneAttachment', title FROM notes WHERE item_id IS NULL AND id NOT IN ({_GONE})",
    "unified_tags": f"SELECT k, string_agg(tag, ',' ORDER BY first) AS tags FROM (SELECT k, tag, min({{'id': id, 'pos': pos}}) AS first FROM (SELECT id, {_KEY} AS k, unnest(t) AS tag, generate_subscripts(t, 1) AS pos FROM (SELECT *, from_json(tags_json, '[\"VARCHAR\"]') AS t FROM (SELECT DISTINCT id, doi, isbn, title, date_created, creators_json, tags_json FROM items))) GROUP BY k, tag) GROUP BY k",
    "entity_groups": f"SELECT k, min(id) AS first_id, count(*) AS n, dense_rank() OVER (ORDER BY min(id)) AS entity_id FROM (SELECT DISTINCT id, {_KEY} AS k FROM items) GROUP BY k",
    "metadata_enrichment": f"SELECT DISTINCT n.id, CASE WHEN {_BAD} AND i.title IS NOT NULL THEN i.title ELSE n.title END AS title, {_BAD} AND i.title IS NOT NULL AS enriched FROM notes n LEFT JOIN (SELECT DISTINCT id, title FROM items) i ON i.id = n.item_id",
}
