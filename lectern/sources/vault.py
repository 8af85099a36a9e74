"""File sources: a tree of Markdown notes and its assets, through binaryFile; text blobs of pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T

# Folders that hold settings, not notes; types by extension.
IGNORED = (".git", ".obsidian", ".trash", "node_modules", "__pycache__")
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "pdf": "application/pdf", "csv": "text/csv", "txt": "text/plain", "json": "application/json", "mp3": "audio/mpeg", "mp4": "video/mp4"}
#: Pages of recovered texts end at the line end nearest to an equal cut, within so many characters.
CUT_RANGE = 600
MAX_PAGES = 2_000


def _files(spark: SparkSession, root: str) -> DataFrame:
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.substring_index(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), base, -1)
    parents = F.slice(F.split(rel, "/"), 1, F.size(F.split(rel, "/")) - 1)
    return files.withColumn("relative_path", rel).filter(~F.arrays_overlap(parents, F.array(*map(F.lit, IGNORED))))


def notes(spark: SparkSession, root: str) -> DataFrame:
    """(note_id, relative_path, folder, filename, markdown, checksum, modified_at) of all *.md; bytes that aren't UTF-8 are replaced."""
    f = _files(spark, root).filter(F.lower("relative_path").endswith(".md"))
    name = F.element_at(F.split("relative_path", "/"), -1)
    folder = F.when(F.contains("relative_path", F.lit("/")), F.regexp_replace("relative_path", "/[^/]*$", "")).otherwise("")
    return f.select(T.note_id(F.col("relative_path")).alias("note_id"), "relative_path", folder.alias("folder"), name.alias("filename"), F.decode("content", "UTF-8").alias("markdown"), F.sha2("content", 256).alias("checksum"), F.col("modificationTime").alias("modified_at"))


def assets(spark: SparkSession, root: str) -> DataFrame:
    f = _files(spark, root).drop("content").filter(~F.lower("relative_path").endswith(".md"))
    ext = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    kind = F.element_at(F.create_map(*[F.lit(x) for p in TYPES.items() for x in p]), ext)
    return f.select("relative_path", F.element_at(F.split("relative_path", "/"), -1).alias("filename"), kind.alias("content_type"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified_at"))


def cut_pages(text: str, pages: int) -> list[str]:
    """A blob into as many pages, each ending at the line end nearest to its equal cut."""
    n = max(1, min(pages or 1, MAX_PAGES, len(text) or 1))
    cuts = [0]
    for i in range(1, n):
        want = len(text) * i // n
        near = [p + 1 for p in (text.rfind("\n", max(cuts[-1], want - CUT_RANGE), want), text.find("\n", want, want + CUT_RANGE)) if p >= 0]
        cuts.append(max(cuts[-1], min(near, key=lambda p: abs(p - want)) if near else want))
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def recovered_pages(blobs: DataFrame) -> DataFrame:
    """blobs (attachment_id, text, pages) -> (attachment_id, page_number, text)."""
    made = F.pandas_udf(lambda t, n: pd.Series([cut_pages(x or "", int(k) if k == k and k else 1) for x, k in zip(t, n)]), "array<string>")
    return blobs.select("attachment_id", F.posexplode(made("text", "pages")).alias("p", "text")).select("attachment_id", (F.col("p") + 1).alias("page_number"), "text")


def needs_recognition(text: Column) -> Column:
    return F.coalesce(T.alnum_count(text), F.lit(0)) < 80


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A source without rows, so that the other sources can go alone."""
    return spark.createDataFrame([], schema)
