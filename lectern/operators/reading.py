"""What is read beside a hit, the chunks that are embedded, lines of text without page layout, and the steps of a run."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..plans import relational as R
from ..session import table
from ..sinks import generations as G
from ..skew import skew_join
from . import folds

# The kinds of annotations that are read from a page.
ANNOTATION_KINDS = ("Highlight", "Underline", "Squiggly", "StrikeOut", "Text", "FreeText", "Ink", "Square")


def page_annotations(found: DataFrame) -> DataFrame:
    """Annotations (attachment_id, page_number, annotation_type, text, comment, ...) of the kinds that are read, with something in them, each fingerprint once: the smallest id counts."""
    own = found.filter(F.col("annotation_type").isin(*ANNOTATION_KINDS) & (F.trim(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("comment", F.lit("")))) != ""))
    mark = F.sha2(F.concat_ws("\x00", "attachment_id", "page_number", "annotation_type", F.coalesce("text", F.lit("")), F.coalesce("comment", F.lit(""))), 256)
    return own.withColumn("fingerprint", mark).groupBy("fingerprint").agg(F.min_by(F.struct("id", "attachment_id", "page_number", "annotation_type", "text", "comment"), "id").alias("r")).select("r.*", "fingerprint")


def page_of(label: Column) -> Column:
    return F.regexp_extract(label, r"([0-9]+)", 1).try_cast("int")


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """(id, kind, context) of every chunk: of a document the clean block on its page or the nearest to it, else the page's text; of an item its title, date, metadata and creators; of an annotation, a note or the vault its own text."""
    c = table(spark, d, "semantic_chunks").select("id", "kind", "item_id", "attachment_id", "page", "text").distinct()
    own = c.select("id", "kind", "item_id", "attachment_id", F.coalesce(page_of(F.col("page")), F.lit(0)).alias("at"), F.coalesce("text", F.lit("")).alias("own"))
    blocks = table(spark, d, "clean_document_blocks").filter("attachment_id IS NOT NULL AND page_start IS NOT NULL").select(F.col("id").alias("block_id"), "attachment_id", "page_start", "page_end", F.col("text").alias("block")).distinct()
    # Of a page's blocks only the first is ever the nearest, so pages meet, not blocks.
    pages = blocks.groupBy("attachment_id", "page_start", "page_end").agg(F.min(F.struct("block_id", "block")).alias("b"))
    docs = own.filter("kind = 'document'")
    best = F.min(F.struct(F.when(F.col("at").between(F.col("page_start"), F.col("page_end")), 0).otherwise(1).alias("r"), F.abs(F.col("page_start") - F.col("at")).alias("far"), F.col("b.block_id"), F.col("b.block"))).alias("n")
    near = skew_join(docs.select("id", "attachment_id", "at"), pages, ["attachment_id"]).groupBy("id").agg(best).select("id", F.col("n.block").alias("block"))
    raw = table(spark, d, "document_pages").groupBy("attachment_id", F.col("page_number").alias("at")).agg(F.min("text").alias("raw"))
    items = table(spark, d, "items").select(F.col("id").alias("item_id"), T.plain_text(F.array_join(F.filter(F.array("title", "date_created", "metadata_json", "creators_json"), lambda x: x != ""), ". ")).alias("item")).distinct()
    j = own.join(near, "id", "left").join(raw, ["attachment_id", "at"], "left").join(items, "item_id", "left")
    some = lambda x: F.when(F.col(x) != "", F.col(x))
    picked = F.when(F.col("kind") == "document", F.coalesce(some("block"), some("raw"))).when(F.col("kind") == "metadata", some("item"))
    return j.select("id", "kind", F.coalesce(picked, T.plain_text(F.col("own"))).alias("context"))


def public(rows: DataFrame) -> DataFrame:
    """What a request shows: columns that begin with _ are kept back."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])


def view(spark: SparkSession, d: str) -> DataFrame:
    """(id, attachment_id, page) a reader opens at for each chunk of a document or annotation: the annotation's page, else where its text is found in the clean blocks, else its own page."""
    c = table(spark, d, "semantic_chunks").filter("attachment_id IS NOT NULL").select("id", "kind", "attachment_id", "text", page_of(F.col("page")).alias("own")).distinct()
    noted = F.col("kind").isin("annotation", "embedded_annotation") & F.col("own").isNotNull()
    from .library import locate

    wanted = c.filter(~noted & F.col("text").isNotNull()).select(F.col("id").alias("key"), "attachment_id", F.col("text").alias("needle"), F.col("own").alias("page"))
    found = locate(table(spark, d, "clean_document_blocks").select("id", "attachment_id", "page_start", "page_end", "text").distinct(), wanted)
    return c.join(found.select(F.col("key").alias("id"), F.col("page").alias("found")), "id", "left").select("id", "attachment_id", F.when(noted, F.col("own")).otherwise(F.coalesce("found", "own")).alias("page"))


def record(key: Column, kind: str, item: Column, attachment: Column, page: Column, title: Column, text: Column) -> list[Column]:
    none = lambda c, t: c.cast(t)
    return [key.alias("chunk_key"), F.lit(kind).alias("kind"), none(item, "bigint").alias("item_id"), none(attachment, "bigint").alias("attachment_id"), none(page, "string").alias("page"), F.coalesce(title, F.lit("")).alias("title"), F.substring(text, 1, folds.CHUNK_CAP).alias("text")]


def produced(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_key, kind, item_id, attachment_id, page, title, text): chunks of item metadata, document sections, annotations of both sorts, notes and vault sections. Chunks without text are left out."""
    from ..plans.text_queries import metadata_text

    t = lambda name: table(spark, d, name)
    none, key = F.lit(None), lambda kind, *parts: F.concat_ws(":", F.lit(kind), *[F.col(p).cast("string") for p in parts])
    c = F.col
    items = t("items").select("id", "title", "item_type", "metadata_json", "creators_json").distinct()
    titles = items.select(c("id").alias("item_id"), c("title").alias("item_title"))
    parts = [items.select(*record(key("metadata", "id"), "metadata", c("id"), none, none, c("title"), metadata_text()))]
    sections = folds.chunk_packing(spark, d)
    owners = t("clean_document_blocks").groupBy("attachment_id").agg(F.min("item_id").alias("item_id"))
    made = sections.join(owners, "attachment_id").join(titles, "item_id", "left")
    parts.append(made.select(*record(key("document", "attachment_id", "section", "label", "ordinal"), "document", c("item_id"), c("attachment_id"), none, c("item_title"), c("text"))).withColumn("kind", F.element_at(F.split("chunk_key", ":"), 4)).withColumn("kind", F.when(c("kind") == "body", "document").otherwise(c("kind"))))
    notes = t("semantic_chunks").filter("kind IN ('annotation', 'embedded_annotation')").select("id", "kind", "item_id", "attachment_id", "page", "text").distinct().join(titles, "item_id")
    for kind in ("annotation", "embedded_annotation"):
        parts.append(notes.filter(c("kind") == kind).select(*record(key(kind, "id"), kind, c("item_id"), c("attachment_id"), c("page"), c("item_title"), c("text"))))
    own = t("notes").select("id", "item_id", "attachment_id", "title", "note_html").distinct().join(titles, "item_id", "left")
    parts.append(own.select(*record(key("note", "id"), "note", c("item_id"), c("attachment_id"), none, F.coalesce("item_title", "title"), T.plain_text(c("note_html")))))
    names = t("obsidian_sections").select("section_id", "note_id").distinct().join(t("obsidian_notes").groupBy("note_id").agg(F.max_by("title", F.struct("imported_at", "checksum")).alias("title")), "note_id")
    packed = folds.note_packing(spark, d).join(names, "section_id")
    parts.append(packed.select(*record(key("obsidian", "section_id", "ordinal"), "obsidian", none, none, none, c("title"), c("text"))))
    return reduce(DataFrame.unionByName, parts).filter(F.trim("text") != "")


# --- text without page layout ------------------------------------------------------------------------------------------------------------------------

NUMBERS, CODE = re.compile(r"\b\d+(?:[.,]\d+)?\b"), re.compile(r"[A-Z]{2,4}\s+\d+\s+[A-Z]{2,4}")
NOTE_START, AUTHOR_START, BULLET = re.compile(r"\d+\s+[^\W\d_]"), re.compile(r"[A-Z]\.[ \t]+[^\W\d_][\w'’-]+"), re.compile(r"(?:[•▪◦–—-]|\(?\d+[.)]|\(?[a-z][.)])\s+", re.I)
NAMED_HEADING = re.compile(r"(?:\d+(?:\.\d+){0,4}\.?\s+)?(?:abstract|introduction|background|methods?|results?|discussion|conclusions?|references|bibliography|appendix|chapter|section|article|contents)\b", re.I)
NUMBERED_HEADING, BANNER = re.compile(r"(?:[IVXLCDM]+|[A-Z]|\d+(?:\.\d+){0,4})[.:]\s+[A-ZÀ-Ž]"), re.compile(r"contents lists available at|official journal", re.I)
FULL, LEAST = 1_200, 450


def line_class(line: str) -> str:
    """table_row, toc_entry, metadata, footnote, heading, list_item or paragraph; the first that matches."""
    t, words = line.strip(), line.split()
    if BANNER.search(t):
        return "metadata"
    if len(t) <= 240 and re.search(r"(?:\.{3,}|-{3,}).*\d+\s*$", t):
        return "toc_entry"
    if len(NUMBERS.findall(t)) >= 2 and len(words) <= 14 or CODE.fullmatch(t):
        return "table_row"
    if NOTE_START.match(t) and (len(t) > 45 or re.search(r"[,;:]|\b(?:18|19|20)\d{2}\b", t)) or AUTHOR_START.match(t) and len(t) > 45:
        return "footnote"
    short = len(t) <= 70 and len(words) <= 9 and (NAMED_HEADING.match(t) or NUMBERED_HEADING.match(t))
    if any(c.isalpha() for c in t) and not re.search(r"[;,:]$", t) and not folds.ENDS.search(t) and (t.isupper() and len(t) <= 120 and len(words) <= 14 or short):
        return "heading"
    return "list_item" if BULLET.match(t) else "paragraph"


def line_blocks(text: str | None, repeated: list[str] | None) -> list[tuple[str, str]]:
    """Lines of a page to blocks (kind, text): lines that recur in the attachment and page numbers go; prose is gathered until it is long enough, or a blank line follows a finished sentence."""
    out: list[tuple[str, str]] = []
    held = ""
    gone = set(repeated or ())

    def flush() -> None:
        nonlocal held
        if held.strip():
            out.append(("paragraph", held.strip()))
        held = ""

    lines = (text or "").replace("\r", "").split("\n")
    for i, line in enumerate(lines):
        t = re.sub(r"[ \t]+", " ", line).strip()
        if not t:
            after = next((x.strip() for x in lines[i + 1 :] if x.strip()), "")
            if folds.ENDS.search(held) and not after[:1].islower():
                flush()
            continue
        if line in gone or re.fullmatch(r"(?:page\s*)?[ivxlcdm\d]+", t, re.I):
            continue
        kind = line_class(t)
        if kind != "paragraph":
            flush()
            out.append((kind, t))
            continue
        held = held[:-1] + t if held.endswith("-") and t[:1].islower() else f"{held} {t}".strip()
        if len(held) >= FULL or len(held) >= LEAST and folds.ENDS.search(held):
            flush()
    flush()
    return out


def unlaid(spark: SparkSession, d: str) -> DataFrame:
    """(attachment_id, page_number, ordinal, kind, text) of all pages, each read on its own; what goes on over pages is joined by paragraph_merge."""
    blocks = F.udf(line_blocks, "array<struct<kind:string,text:string>>", useArrow=True)
    gone = R.run(spark, d, "repeated_lines").groupBy("attachment_id").agg(F.collect_list("line").alias("repeated"))
    pages = table(spark, d, "document_pages").select("id", "attachment_id", "page_number", "text").distinct().join(gone, "attachment_id", "left")
    return pages.select("attachment_id", "page_number", F.posexplode(blocks("text", "repeated")).alias("ordinal", "b")).select("attachment_id", "page_number", "ordinal", "b.kind", "b.text")


# --- runs ---------------------------------------------------------------------------------------------------------------------------------------------


def stages(has_library: bool, has_vault: bool) -> list[str]:
    """The steps of a run, in order: a source that isn't configured has none, and what both feed comes after both."""
    if not (has_library or has_vault):
        raise ValueError("no source is configured")
    library = ["unify", "extract", "recover", "clean", "enrich"] if has_library else ["empty_library"]
    return [*library, *(["vault"] if has_vault else []), "indexes", "chunks", "publish"]


def registry(known: list[str], found: list[str]) -> list[str]:
    """Names of models, those known first, then those an index was found for; each once, names that can't be one left out."""
    return list(dict.fromkeys(m.strip() for m in (*known, *found) if m and re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._:/-]{0,199}", m.strip())))


@dataclass
class Queue:
    """Models to be embedded one after the other. What is left is stored after each, so a run that ends early goes on where it stood.

    path: a small JSON file on any file system Hadoop knows."""

    spark: SparkSession
    path: str
    done: list[str] = field(default_factory=list)

    def left(self) -> list[str]:
        return G.read_json(self.spark, self.path) or []

    def run(self, models: list[str], embed: Callable[[str], None]) -> list[str]:
        waiting = self.left() or list(dict.fromkeys(models))
        G.write_json(self.spark, self.path, waiting)
        while waiting:
            embed(waiting[0])
            self.done.append(waiting.pop(0))
            G.write_json(self.spark, self.path, waiting)
        return self.done


def report(rows: DataFrame) -> str:
    """A run's counters (stage, n) as JSON; a handful of rows by nature."""
    return json.dumps({r["stage"]: r["n"] for r in rows.limit(1000).collect()}, sort_keys=True)


QUERIES = {
    "hit_contexts": contexts, "reader_view": view, "chunk_producers": produced, "unlaid_blocks": unlaid,
    "page_annotations": lambda s, d: page_annotations(table(s, d, "semantic_chunks").filter("attachment_id IS NOT NULL").select("id", "attachment_id", page_of(F.col("page")).alias("page_number"), F.when(F.col("kind") == "embedded_annotation", "Highlight").when(F.col("kind") == "annotation", "Ink").otherwise("Link").alias("annotation_type"), "text", F.col("section_title").alias("comment"))),
    "public_view": lambda s, d: public(table(s, d, "semantic_chunks").select("id", "kind", F.col("text").alias("_context")).distinct()),
}
_P = "try_cast(nullif(regexp_extract(page, '([0-9]+)', 1), '') AS INT)"
_WS = lambda x: f"trim(regexp_replace({x}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"


def _contexts_sql() -> str:
    from ..plans.text_queries import _tags, _unescape

    plain = lambda x: _WS(_unescape(_tags(x)))
    item = plain("array_to_string(list_filter([title, date_created, metadata_json, creators_json], lambda x: x <> ''), '. ')")
    return f"""WITH c AS (SELECT DISTINCT id, kind, item_id, attachment_id, coalesce({_P}, 0) AS at_, coalesce(text, '') AS own FROM semantic_chunks),
n AS (SELECT c.id, b.text AS block FROM c JOIN (SELECT DISTINCT id AS block_id, attachment_id, page_start, page_end, text FROM clean_document_blocks WHERE page_start IS NOT NULL) b ON b.attachment_id = c.attachment_id WHERE c.kind = 'document'
  QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN at_ BETWEEN page_start AND page_end THEN 0 ELSE 1 END, abs(page_start - at_), block_id) = 1),
r AS (SELECT attachment_id, page_number AS at_, min(text) AS raw FROM document_pages GROUP BY ALL), i AS (SELECT DISTINCT id AS item_id, {item} AS item FROM items)
SELECT c.id, c.kind, coalesce(CASE c.kind WHEN 'document' THEN coalesce(nullif(block, ''), nullif(raw, '')) WHEN 'metadata' THEN nullif(item, '') END, {plain('own')}) AS context
FROM c LEFT JOIN n USING (id) LEFT JOIN r ON r.attachment_id = c.attachment_id AND r.at_ = c.at_ LEFT JOIN i ON i.item_id = c.item_id"""


SQL = {
    "hit_contexts": _contexts_sql(),
    "public_view": "SELECT DISTINCT id, kind FROM (SELECT DISTINCT id, kind, text FROM semantic_chunks)",
    "page_annotations": f"""WITH a AS (SELECT DISTINCT id, attachment_id, {_P} AS page_number, CASE kind WHEN 'embedded_annotation' THEN 'Highlight' ELSE 'Ink' END AS annotation_type, text, section_title AS comment FROM semantic_chunks WHERE attachment_id IS NOT NULL AND kind IN ('annotation', 'embedded_annotation') AND trim(concat_ws(' ', coalesce(text, ''), coalesce(section_title, ''))) <> '')
SELECT *, sha256(concat_ws(chr(0), attachment_id, page_number, annotation_type, coalesce(text, ''), coalesce(comment, ''))) AS fingerprint FROM a QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1""",
}
