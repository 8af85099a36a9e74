"""The six lexical indexes: their rows, their storage as one generation, and the search over all of them.

Rows of an index are (key, item_id, folder, searched columns). Scores of different indexes are compared directly, each with the boost of its kind. A request reads
a published generation (build), so no text is tokenised for it; without one the rows are indexed on the fly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..session import cut, ensure_checkpoint_dir, table
from ..sinks import generations as G
from . import search as S


@dataclass(frozen=True)
class Index:
    """weights: of the searched columns; a column of weight 0 is matched and counts in the length, but gives no score."""

    kind: str
    weights: dict[str, float]
    boost: float = 0.0


# Searched columns with their weights, and what a kind gains (lower scores are better).
INDEXES = {
    "page": Index("document", {"parent_title": 3.0, "authors": 1.0, "page_text": 8.0}),
    "annotation": Index("annotation", {"parent_title": 2.0, "authors": 1.0, "annotation_text": 8.0, "comment": 5.0, "page_label": 0.0}, S.KIND_BOOST["annotation"]),
    "embedded": Index("embedded_annotation", {"parent_title": 1.0, "annotation_type": 1.0, "annotation_text": 1.0, "comment": 1.0}, S.KIND_BOOST["embedded_annotation"]),
    "item": Index("metadata", {"title": 8.0, "authors": 4.0, "metadata": 2.0, "tags": 3.0, "collections": 3.0}),
    "note": Index("note", {"title": 1.0, "note_text": 1.0}),
    "vault": Index("obsidian", {"title": 4.0, "heading": 2.0, "path": 1.0, "tags": 1.0, "authors": 1.0, "text": 6.0}, S.KIND_BOOST["obsidian"]),
}
#: What a scope of a request searches; a scope that isn't known finds nothing.
SCOPES = {"all": tuple(INDEXES), "documents": ("page",), "annotations": ("annotation", "embedded"), "metadata": ("item",), "notes": ("note",), "obsidian": ("vault",)}


def author_line(json: Column) -> Column:
    names = F.transform(F.from_json(json, T.CREATORS), lambda p: F.trim(F.concat_ws(" ", p["firstName"], p["lastName"])))
    return F.coalesce(F.array_join(F.filter(names, lambda n: n != ""), " ; "), F.lit(""))


def metadata_lines(json: Column) -> Column:
    """A line `name: value` for each field that isn't empty, by name."""
    some = F.filter(F.array_sort(F.map_entries(F.from_json(json, "map<string,string>"))), lambda e: F.trim(e["value"]) != "")
    return F.coalesce(F.array_join(F.transform(some, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"), F.lit(""))


def joined(json: Column, by: str) -> Column:
    return F.coalesce(F.array_join(F.from_json(json, "array<string>"), by), F.lit(""))


def rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The rows of an index, once each. Columns of the tables other than those named play no part."""
    t = lambda n, *c: table(spark, d, n).select(*c).distinct()
    items = t("items", F.col("id").alias("item_id"), F.col("title").alias("parent_title"), "creators_json")
    none = F.lit(None).cast("string").alias("folder")
    if name == "page":
        pages = t("document_pages", F.col("id").cast("string").alias("key"), "item_id", F.col("text").alias("page_text"))
        return pages.join(items, "item_id").select("key", "item_id", none, "parent_title", F.col("creators_json").alias("authors"), "page_text")
    if name in ("annotation", "embedded"):
        c = t("semantic_chunks", F.col("id").cast("string").alias("key"), "item_id", "kind", "label", "text", "section_title", "page").filter(F.col("kind") == INDEXES[name].kind).join(items, "item_id")
        shown = [author_line(F.col("creators_json")).alias("authors")] if name == "annotation" else [F.col("label").alias("annotation_type")]
        return c.select("key", "item_id", none, "parent_title", *shown, F.col("text").alias("annotation_text"), F.col("section_title").alias("comment"), *([F.col("page").alias("page_label")] if name == "annotation" else []))
    if name == "item":
        i = t("items", "id", "title", "creators_json", "metadata_json", "tags_json", "collections_json")
        ids = i.select("id", F.explode(F.from_json("collections_json", "array<bigint>")).alias("collection_id")).distinct()
        names = ids.join(t("zotero_collections", "collection_id", "name"), "collection_id").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ; ").alias("collections"))
        shown = [author_line(F.col("creators_json")).alias("authors"), metadata_lines(F.col("metadata_json")).alias("metadata"), joined(F.col("tags_json"), " ; ").alias("tags")]
        return i.join(names, "id", "left").select(F.col("id").cast("string").alias("key"), F.col("id").alias("item_id"), none, "title", *shown, F.coalesce("collections", F.lit("")).alias("collections"))
    if name == "note":
        return t("notes", F.col("id").cast("string").alias("key"), "item_id", none, "title", F.col("note_html").alias("note_text"))
    newest = F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc("imported_at"), "checksum"))
    notes = t("obsidian_notes", "note_id", "folder", "title", F.col("relative_path").alias("path"), "tags_json", "authors_json", "imported_at", "removed_at", "checksum").withColumn("rn", newest).filter("rn = 1 AND removed_at IS NULL")
    sections = t("obsidian_sections", F.col("section_id").alias("key"), "note_id", "heading", F.col("markdown").alias("text"))
    shown = [joined(F.col("tags_json"), " ").alias("tags"), joined(F.col("authors_json"), " ").alias("authors")]
    return sections.join(notes, "note_id").select("key", F.lit(None).cast("bigint").alias("item_id"), "folder", "title", "heading", "path", *shown, "text")


def build(spark: SparkSession, d: str, root: str, names: tuple[str, ...] = tuple(INDEXES)) -> dict:
    """Store the indexes as one generation and publish it, with the registry of what it holds."""
    generation = G.reserve(spark, root)
    for name in names:
        S.write_index(S.index(rows(spark, d, name), "key", list(INDEXES[name].weights)), f"{generation}/{name}")
        G.write(rows(spark, d, name).select("key", "item_id", "folder"), generation, f"{name}_keys")
    return G.publish(spark, root, generation, {f"{n}/corpus": 1 for n in names})


def scored(spark: SparkSession, d: str, name: str, phrases: list[list[str]], generation: str | None = None, any_term: bool = False) -> DataFrame:
    """(key, score) with the boost of the kind, from the stored index or on the fly."""
    ix = INDEXES[name]
    if generation:
        found = S.bm25_stored(spark, f"{generation}/{name}", ix.weights, phrases, any_term)
    else:
        found = S.bm25(S.index(rows(spark, d, name), "key", list(ix.weights)), ix.weights, phrases, any_term)
    return found.select("key", (F.col("score") + ix.boost).alias("score"))


def hits(spark: SparkSession, d: str, query: str, limit: int, scope: str = "all", exact: bool = False, generation: str | None = None, allowed: DataFrame | None = None, folders: tuple[str, ...] | None = None) -> DataFrame:
    """(kind, key, score, place): the best of each index of the scope, library and vault five to one if the scope is all, else by score.

    allowed (item_id) holds for all indexes but the vault's, folders for the vault's alone. Filters come after the scores: statistics are those of the whole index."""
    parts = []
    for name in SCOPES.get(scope, ()):
        s = scored(spark, d, name, S.parse(query, exact), generation)
        if name == "vault" and folders is not None or name != "vault" and allowed is not None:
            keys = spark.read.parquet(f"{generation}/{name}_keys") if generation else rows(spark, d, name).select("key", "item_id", "folder")
            keys = keys.filter(F.col("folder").isin(*folders) if folders else F.lit(False)) if name == "vault" else keys.join(allowed, "item_id", "left_semi")
            s = s.join(keys.select("key").distinct(), "key", "left_semi")
        parts.append(S.top(s, limit).select(F.lit(INDEXES[name].kind).alias("kind"), "key", F.round("score", 9).alias("score")))
    if not parts:
        return spark.createDataFrame([], "kind string,key string,score double,place int")
    all_ = reduce(DataFrame.unionByName, parts)  # at most `limit` rows of each index
    if scope != "all":
        return all_.withColumn("place", F.row_number().over(Window.orderBy("score", "kind", "key"))).filter(F.col("place") <= limit)
    side = (F.col("kind") == "obsidian").cast("int")
    ranked = all_.withColumn("side", side).withColumn("r", F.row_number().over(Window.partitionBy("side").orderBy("score", "kind", "key")))
    block = F.when(F.col("side") == 0, F.ceil(F.col("r") / 5)).otherwise(F.col("r"))
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(block, "side", "r"))).filter(F.col("place") <= limit).select("kind", "key", "score", "place")


def lexical_stored(spark: SparkSession, d: str) -> DataFrame:
    """The search over all indexes from a generation that is stored and published first; the generation is removed after the page is taken."""
    root = f"{ensure_checkpoint_dir(spark)}/lectern-indexes-{G.reserve(spark, '')[-12:]}"
    manifest = build(spark, d, root)
    page = cut(hits(spark, d, S.QUERY, 41, generation=manifest["generation"]))
    G.remove(spark, root)
    return page


QUERIES = {
    "lexical_stored": lexical_stored,
    "lexical_all": lambda s, d: hits(s, d, S.QUERY, 41),
    "lexical_exact": lambda s, d: hits(s, d, "contested theory", 41, exact=True),
    **{f"lexical_{x}": lambda s, d, x=x: hits(s, d, "survey", 41, x) for x in ("annotations", "metadata", "notes", "obsidian", "unknown")},
    **{f"index_rows_{n}": lambda s, d, n=n: rows(s, d, n) for n in INDEXES},
    "index_registry": lambda s, d: s.createDataFrame([(n, x.kind, ",".join(x.weights), x.boost) for n, x in INDEXES.items()], "name string,kind string,columns string,boost double"),
}
_PEOPLE = "coalesce(array_to_string(list_filter(list_transform(from_json(creators_json, '[{\"firstName\":\"VARCHAR\",\"lastName\":\"VARCHAR\"}]'), lambda x: trim(concat_ws(' ', x.firstName, x.lastName), ' ')), lambda n: n <> ''), ' ; '), '')"
_LIST = lambda c, by: f"coalesce(array_to_string(from_json({c}, '[\"VARCHAR\"]'), '{by}'), '')"
_META = "coalesce((SELECT string_agg(k || ': ' || v, chr(10) ORDER BY k) FROM (SELECT k, json_extract_string(metadata_json, '$.\"' || k || '\"') AS v FROM (SELECT unnest(json_keys(metadata_json)) AS k)) WHERE trim(v) <> ''), '')"
_ITEMS = "(SELECT DISTINCT id AS item_id, title AS parent_title, creators_json FROM items)"
_CHUNKS = "(SELECT DISTINCT id::VARCHAR AS key, item_id, kind, label, text, section_title, page FROM semantic_chunks)"
ROWS_SQL = {
    "page": f"SELECT key, item_id, NULL::VARCHAR AS folder, parent_title, creators_json AS authors, page_text FROM (SELECT DISTINCT id::VARCHAR AS key, item_id, text AS page_text FROM document_pages) p JOIN {_ITEMS} i USING (item_id)",
    "annotation": f"SELECT key, item_id, NULL::VARCHAR AS folder, parent_title, {_PEOPLE} AS authors, text AS annotation_text, section_title AS comment, page AS page_label FROM {_CHUNKS} c JOIN {_ITEMS} i USING (item_id) WHERE kind = 'annotation'",
    "embedded": f"SELECT key, item_id, NULL::VARCHAR AS folder, parent_title, label AS annotation_type, text AS annotation_text, section_title AS comment FROM {_CHUNKS} c JOIN {_ITEMS} i USING (item_id) WHERE kind = 'embedded_annotation'",
    "item": f"SELECT id::VARCHAR AS key, id AS item_id, NULL::VARCHAR AS folder, title, {_PEOPLE} AS authors, {_META} AS metadata, {_LIST('tags_json', ' ; ')} AS tags, coalesce((SELECT string_agg(DISTINCT name, ' ; ' ORDER BY name) FROM zotero_collections z WHERE z.collection_id IN (SELECT unnest(from_json(collections_json, '[\"BIGINT\"]')))), '') AS collections FROM (SELECT DISTINCT id, title, creators_json, metadata_json, tags_json, collections_json FROM items)",
    "note": "SELECT DISTINCT id::VARCHAR AS key, item_id, NULL::VARCHAR AS folder, title, note_html AS note_text FROM notes",
    "vault": f"SELECT key, NULL::BIGINT AS item_id, folder, title, heading, path, {_LIST('tags_json', ' ')} AS tags, {_LIST('authors_json', ' ')} AS authors, text FROM (SELECT DISTINCT section_id AS key, note_id, heading, markdown AS text FROM obsidian_sections) s JOIN (SELECT DISTINCT note_id, folder, title, relative_path AS path, tags_json, authors_json, removed_at FROM obsidian_notes QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY imported_at DESC, checksum) = 1) n USING (note_id) WHERE removed_at IS NULL",
}


def hits_sql(phrases: list[list[str]], scope: str = "all", limit: int = 41) -> str:
    parts = [f"SELECT '{INDEXES[n].kind}' AS kind, key, round(score + {INDEXES[n].boost}, 9) AS score FROM ({S.bm25_sql(phrases, INDEXES[n].weights, f'ORDER BY x, key LIMIT {limit}', source=ROWS_SQL[n], digits=15)})" for n in SCOPES[scope]]
    all_ = " UNION ALL ".join(f"({p})" for p in parts)
    if scope != "all":
        return f"SELECT kind, key, score, row_number() OVER (ORDER BY score, kind, key)::INTEGER AS place FROM ({all_}) QUALIFY place <= {limit}"
    return f"WITH r AS (SELECT *, kind = 'obsidian' AS side, row_number() OVER (PARTITION BY kind = 'obsidian' ORDER BY score, kind, key) AS r FROM ({all_})) SELECT kind, key, score, row_number() OVER (ORDER BY CASE WHEN side THEN r ELSE ceil(r / 5) END, side, r)::INTEGER AS place FROM r QUALIFY place <= {limit}"


SQL = {
    "lexical_stored": hits_sql([["charter"], ["survey"]]), "lexical_all": hits_sql([["charter"], ["survey"]]), "lexical_exact": hits_sql([["contested", "theory"]]),
    **{f"lexical_{x}": hits_sql([["survey"]], x) for x in ("annotations", "metadata", "notes", "obsidian")},
    "lexical_unknown": "SELECT NULL::VARCHAR AS kind, NULL::VARCHAR AS key, NULL::DOUBLE AS score, NULL::INTEGER AS place WHERE false",
    **{f"index_rows_{n}": s for n, s in ROWS_SQL.items()},
    "index_registry": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{x.kind}', '{','.join(x.weights)}', {x.boost}::DOUBLE)" for n, x in INDEXES.items()) + ") t(name, kind, columns, boost)",
}
