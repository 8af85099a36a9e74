"""Lookups, readiness, evidence and maintenance over the library's tables; geometry and layout of page words."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..session import table
from ..skew import skew_join

def pivot_fields(values: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """Entity-attribute-value rows to one map per entity; of several values of a field the smallest."""
    one = values.filter(F.col(field).isNotNull()).groupBy(key, field).agg(F.min(value).alias("v"))
    return one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, "v")))).alias("fields"))


def ordered_children(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Children of each key as an array of structs in their order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("children"))


def heading_paths(sections: DataFrame, separator: str = " › ") -> DataFrame:
    """(section_id, path): the headings above a section by level. A level's last heading counts if no higher heading came after it."""
    w = Window.partitionBy("note_id").orderBy("ordinal", "section_id").rowsBetween(Window.unboundedPreceding, 0)
    s = sections
    levels = range(1, 7)
    for k in levels:
        at = F.when(F.col("heading_level") == k, F.struct(F.col("ordinal").alias("o"), F.col("heading").alias("h")))
        s = s.withColumn(f"_l{k}", F.last(at, ignorenulls=True).over(w))
    parts = []
    for k in levels:
        above = [F.coalesce(F.col(f"_l{i}.o"), F.lit(-1)) for i in range(1, k)]
        alive = (F.col(f"_l{k}.o") > F.greatest(F.lit(-1), *above)) if above else F.col(f"_l{k}.o").isNotNull()
        parts.append(F.when(alive & (F.col("heading_level") >= k), F.col(f"_l{k}.h")))
    return s.select("section_id", F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), separator).alias("path"))


def locate(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, attachment_id, needle, page) -> (key, block_id, page): the first block whose text holds the needle, or its first or last 18 words; else the block of the page; else the first block."""
    head = lambda c: F.array_join(F.slice(F.split(c, " "), 1, 18), " ")
    tail = lambda c: F.array_join(F.slice(F.split(c, " "), F.greatest(F.lit(1), F.size(F.split(c, " ")) - 17), F.lit(18)), " ")
    b = blocks.select(F.col("id").alias("block_id"), "attachment_id", "page_start", "page_end", T.locator(F.col("text")).alias("t"))
    n = wanted.withColumn("n", T.locator(F.col("needle")))
    j = skew_join(b, n, ["attachment_id"])
    rank = F.when(F.col("t").contains(F.col("n")), 0).when(F.col("t").contains(head(F.col("n"))) | F.col("t").contains(tail(F.col("n"))), 1).when(F.col("page").between(F.col("page_start"), F.col("page_end")), 2).otherwise(3)
    best = F.min(F.struct(rank.alias("r"), F.col("page_start"), F.col("block_id"))).alias("b")
    return j.groupBy("key").agg(best, F.min("page").alias("page")).select("key", "b.block_id", F.when(F.col("b.r") < 2, F.col("b.page_start")).otherwise(F.coalesce("page", "b.page_start")).alias("page"))


def validate_evidence(claimed: DataFrame, expected: DataFrame) -> DataFrame:
    """claimed (occurrence, source, start, stop) that name an expected pair (occurrence, source, units) and a span within its units."""
    return claimed.join(expected, ["occurrence", "source"]).filter((F.col("start") >= 1) & (F.col("start") <= F.col("stop")) & (F.col("stop") <= F.col("units"))).select("occurrence", "source", "start", "stop")


def ready(info: DataFrame, model: str, digest: str, stamp: str) -> DataFrame:
    """info (key, value) of an index -> one row (model_current, source_current, ready)."""
    v = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    row = info.agg(v("model").alias("m"), v("model_identity").alias("i"), v("completed_at").alias("c"), v("clean_text_completed_at").alias("s"), v("chunks").alias("n"))
    current = (F.col("m") == model) & (F.col("i") == digest)
    fresh = F.col("s") == stamp
    some = F.coalesce(F.col("n").try_cast("long"), F.lit(0)) > 0
    no = F.lit(False)
    return row.select(F.coalesce(current, no).alias("model_current"), F.coalesce(fresh, no).alias("source_current"), (F.coalesce(current & fresh, no) & some & F.col("c").isNotNull()).alias("ready"))


def info(rows: DataFrame, integers: tuple[str, ...] = ("notes", "sections", "links", "assets", "tags")) -> dict:
    """Key and value rows as one dict; a handful of keys by nature."""
    out = {r["key"]: r["value"] for r in rows.limit(1000).collect()}
    return {k: int(v) if k in integers and str(v).isdigit() else v for k, v in out.items()}


def history_view(history: DataFrame, generation: str) -> DataFrame:
    """Newest first; saved ids of another generation are blanked, as they name other rows now."""
    stale = ~F.col("generation").eqNullSafe(F.lit(generation))
    ids = [c for c in history.columns if c.endswith("_id") and c != "id"]
    return history.withColumns({c: F.when(stale, None).otherwise(F.col(c)) for c in ids}).orderBy(F.desc("updated_at"), F.desc("id"))


def words_in_boxes(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """words (page, x0, y0, x1, y1, word) over boxes (key, page, x0, y0, x1, y1): text of each key's words in reading order."""
    b = boxes.select("key", "page", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    over = (F.least("x1", "bx1") > F.greatest("x0", "bx0")) & (F.least("y1", "by1") > F.greatest("y0", "by0"))
    j = skew_join(words, b, ["page"]).filter(over)
    return j.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.round("y0", 1).alias("top"), "x0", "word"))).alias("w")).select("key", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


def title_guess(lines: DataFrame) -> DataFrame:
    """lines (document, top, height, size, text, position) -> (document, title): the largest letters in the upper 55 %, up to four lines within 1.2 points."""
    some = lines.filter((F.col("top") <= 0.55 * F.col("height")) & F.length("text").between(12, 350) & (F.col("size") >= 11))
    largest = some.groupBy("document").agg(F.max("size").alias("largest"))
    near = some.join(largest, "document").filter(F.col("size") >= F.col("largest") - 1.2)
    return near.groupBy("document").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("position", "text"))), 1, 4), lambda x: x["text"]), " ").alias("title"))


def split_authors(c: Column) -> Column:
    """Names parted by semicolons, `and` or commas; thirty at most."""
    parts = F.split(F.regexp_replace(c, r"\s+(and|und|et|i)\s+", ";"), r"\s*;\s*")
    parts = F.when(F.size(parts) > 1, parts).otherwise(F.split(c, r"\s*,\s*"))
    return F.slice(F.filter(F.transform(parts, F.trim), lambda x: x != ""), 1, 30)


def guarded(root: str, path: str) -> bool:
    """Whether a relative path stays under the root."""
    parts: list[str] = []
    for p in PurePosixPath(path.replace("\\", "/")).parts:
        if p == "..":
            if not parts:
                return False
            parts.pop()
        elif p == "/" or re.fullmatch(r"[A-Za-z]:", p):
            return False
        elif p != ".":
            parts.append(p)
    return bool(root)


def embed(texts: DataFrame, model, dimensions: int) -> DataFrame:
    """texts (key, text) -> (key, embedding) of unit length by a callable list[str] -> list[list[float]], a batch at a time; a zero vector stays."""

    def run(frames):
        for f in frames:
            v = model(f["text"].tolist())
            if len(v) != len(f):
                raise ValueError(f"{len(v)} vectors for {len(f)} texts")
            yield pd.DataFrame({"key": f["key"], "embedding": v})

    raw = texts.select("key", "text").mapInPandas(run, "key string,embedding array<float>").filter(F.assert_true(F.size("embedding") == dimensions, F.lit("embedding of another length")).isNull())
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return raw.select("key", F.transform("embedding", lambda x: (x / F.when(norm == 0, 1.0).otherwise(norm)).cast("float")).alias("embedding"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "semantic_chunks").filter("text IS NOT NULL AND attachment_id IS NOT NULL")
    wanted = c.select(F.col("id").alias("key"), "attachment_id", F.col("text").alias("needle"), F.regexp_extract("page", r"([0-9]+)", 1).try_cast("int").alias("page")).distinct()
    blocks = table(spark, d, "clean_document_blocks").select("id", "attachment_id", "page_start", "page_end", "text").distinct()
    return locate(blocks, wanted)


QUERIES = {
    "heading_paths": lambda s, d: heading_paths(table(s, d, "obsidian_sections").select("section_id", "note_id", "ordinal", "heading", "heading_level").distinct()),
    "passage_locate": _passages,
    "field_pivot": lambda s, d: pivot_fields(table(s, d, "item_sources").select("item_id", F.explode(F.from_json("metadata_json", "map<string,string>")).alias("field", "value")), "item_id", "field", "value").select("item_id", F.to_json("fields").alias("fields")),
    "normalised_vectors": lambda s, d: table(s, d, "embeddings").select("vec_id", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm")).select("vec_id", F.round("norm", 6).alias("norm")),
    "author_split": lambda s, d: table(s, d, "items").select("id", F.size(split_authors(F.array_join(T.creator_names(F.col("creators_json")), "; "))).alias("n")).distinct(),
}
from ..plans.text_queries import SQL as _TEXT_SQL  # noqa: E402

_AUTHORS = f"SELECT key AS id, names AS n FROM ({_TEXT_SQL['creator_names']}) c"
_LEVELS = range(1, 7)
_LAST = ", ".join(f"last_value(CASE WHEN heading_level = {k} THEN {{'o': ordinal, 'h': heading}} END IGNORE NULLS) OVER w AS l{k}" for k in _LEVELS)
_ALIVE = [f"CASE WHEN heading_level >= {k} AND l{k} IS NOT NULL AND l{k}.o > greatest({', '.join(['-1', *(f'coalesce(l{i}.o, -1)' for i in range(1, k))])}) THEN l{k}.h END" if k > 1 else "CASE WHEN heading_level >= 1 AND l1 IS NOT NULL THEN l1.h END" for k in _LEVELS]
SQL = {
    "normalised_vectors": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings",
    "field_pivot": "SELECT item_id, '{' || coalesce(string_agg(to_json(k)::VARCHAR || ':' || coalesce(to_json(v)::VARCHAR, 'null'), ',' ORDER BY k), '') || '}' AS fields FROM (SELECT item_id, k, min(v) AS v FROM (SELECT item_id, k, json_extract_string(metadata_json, '$.\"' || k || '\"') AS v FROM (SELECT *, unnest(json_keys(metadata_json)) AS k FROM item_sources WHERE metadata_json IS NOT NULL)) GROUP BY item_id, k) GROUP BY item_id",
    "heading_paths": f"SELECT section_id, array_to_string(list_filter([{', '.join(_ALIVE)}], lambda x: x IS NOT NULL), ' › ') AS path FROM (SELECT *, {_LAST} FROM (SELECT DISTINCT section_id, note_id, ordinal, heading, heading_level FROM obsidian_sections) s WINDOW w AS (PARTITION BY note_id ORDER BY ordinal, section_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    "author_split": "SELECT DISTINCT id, len(list_filter(list_transform(p, lambda x: trim(x, ' ')), lambda x: x <> ''))::INTEGER AS n FROM (SELECT id, CASE WHEN len(regexp_split_to_array(regexp_replace(n, '\\s+(and|und|et|i)\\s+', ';', 'g'), '\\s*;\\s*')) > 1 THEN regexp_split_to_array(regexp_replace(n, '\\s+(and|und|et|i)\\s+', ';', 'g'), '\\s*;\\s*') ELSE regexp_split_to_array(n, '\\s*,\\s*') END[1:30] AS p FROM (" + _AUTHORS + ") a) b",
}
