"""Stateful text operators whose next step depends on what was merged before: paragraph merge, chunk packing, evidence units, context packing.

Each is a plain function over one document's ordered parts. Documents are cut where the state starts anew (a heading), so what one group holds is a
section; those groups are folded by applyInPandas.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..session import table

CHUNK_TARGET, CHUNK_CAP = 4_000, 12_000
MERGE_CAP = 4_500
UNIT_CAP = 800
HEADING_PART, HEADING_CAP = 70, 140
ENDS = re.compile(r"[.!?][\"'”»)\]]*\s*$")


def merge_paragraphs(parts: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """(type, text, page) in order: a paragraph goes on into the next one if it has no sentence end or that begins in lower case, at most a page lies between, and both stay below MERGE_CAP.

    A list item without a stop may be gone on with, too. Headings that follow each other on a page, the first without an end and both short, are one. Without page layout nothing speaks against lines of one page belonging together."""
    out: list[tuple[str, str, int]] = []
    last_page = None
    for kind, text, page in parts:
        before_kind, before = (out[-1][0], out[-1][1].rstrip()) if out else ("", "")
        open_ = before_kind == "paragraph" or before_kind == "list_item" and not re.search(r"[.;:]$", before)
        goes_on = not ENDS.search(before) or text[:1].islower()
        if kind == "paragraph" and open_ and goes_on and page - last_page <= 1 and len(before) + len(text) < MERGE_CAP:
            joined = before[:-1] + text if before.endswith("-") and text[:1].islower() else f"{before} {text}"
            out[-1] = (before_kind, joined, out[-1][2])
        elif kind == before_kind == "heading" and page == last_page and len(text) <= HEADING_PART and len(before) + len(text) < HEADING_CAP and not ENDS.search(before):
            out[-1] = (kind, f"{before} {text}", out[-1][2])
        else:
            out.append((kind, text, page))
        last_page = page
    return out


def pack(texts: list[str], target: int = CHUNK_TARGET, cap: int = CHUNK_CAP) -> list[str]:
    """Whole texts into chunks of up to target characters; one beyond the cap is cut at it."""
    out: list[str] = []
    for text in texts:
        for piece in [text[i : i + cap] for i in range(0, len(text), cap)] or [""]:
            if out and len(out[-1]) + 2 + len(piece) <= target:
                out[-1] = f"{out[-1]}\n\n{piece}"
            elif piece:
                out.append(piece)
    return out


def evidence_units(text: str, cap: int = UNIT_CAP) -> list[tuple[int, int, str]]:
    """Sentence-like spans with offsets; longer ones are cut at the last blank before the cap."""
    out = []
    for m in re.finditer(r"\S[\s\S]*?(?:[.!?…][\"'”»)\]]*(?=\s|$)|\n\s*\n|$)", text or ""):
        a, z = m.start(), m.end()
        while z - a > cap:
            b = text.rfind(" ", a + 1, a + cap)
            b = b if b > a else a + cap
            out.append((a, b, text[a:b].strip()))
            a = b
        if text[a:z].strip():
            out.append((a, z, text[a:z].strip()))
    return out


def pack_context(passages: list[str], budget: int, each: int = 3_200, least: int = 300) -> list[str]:
    """Passages in order, each cut to `each` and to what is left, until less than `least` is left."""
    out = []
    for p in passages:
        if budget < least:
            break
        out.append(p[: min(each, budget)])
        budget -= len(out[-1])
    return out


def context_size(characters: int, ladder: tuple[int, ...] = (4096, 8192, 16384, 32768, 65536, 131072)) -> int:
    """The smallest context that holds the estimated tokens and the answer."""
    need = -(-characters // 2) + 2048
    for size in ladder:
        if size >= need:
            return size
    raise ValueError(f"no context of the ladder holds {need} tokens")


def citations(text: Column) -> Column:
    """Distinct numbers of [n] and [n, m], ascending."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(\d{1,3}(?:\s*,\s*\d{1,3})*)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda x: x.cast("int"))))))


def content_hash(model: Column, identity: Column, dimensions: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", model, identity, dimensions.cast("string"), text), 256)


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with the number of the section they stand in: the state of every fold starts anew there."""
    w = Window.partitionBy("attachment_id").orderBy("ordinal", "id").rowsBetween(Window.unboundedPreceding, 0)
    b = table(spark, d, "clean_document_blocks").filter("text IS NOT NULL").dropDuplicates(["id"])
    return b.select("id", "attachment_id", "ordinal", F.coalesce("block_type", F.lit("paragraph")).alias("kind"), "text", F.coalesce("page_start", F.lit(0)).alias("page")).withColumn("section", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(w))


def paragraph_merge(spark: SparkSession, d: str) -> DataFrame:
    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ordinal", "id"])
        rows = merge_paragraphs(list(zip(f["kind"], f["text"], f["page"])))
        return pd.DataFrame([(f["attachment_id"].iloc[0], f["section"].iloc[0], i, *r) for i, r in enumerate(rows)], columns=["attachment_id", "section", "ordinal", "kind", "text", "page"])

    return _sections(spark, d).groupBy("attachment_id", "section").applyInPandas(fold, "attachment_id bigint,section bigint,ordinal bigint,kind string,text string,page int")


def chunk_packing(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the sections, footnotes and tables apart, with a hash of what would be embedded."""

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ordinal", "id"])
        rows = []
        for label, kinds in (("body", ("paragraph", "list_item", "heading")), ("footnote", ("footnote",)), ("table", ("table_row",))):
            for i, t in enumerate(pack(f.loc[f["kind"].isin(kinds), "text"].tolist())):
                rows.append((f["attachment_id"].iloc[0], f["section"].iloc[0], label, i, t, hashlib.sha256(f"{label}\0{t}".encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["attachment_id", "section", "label", "ordinal", "text", "content_hash"])

    return _sections(spark, d).groupBy("attachment_id", "section").applyInPandas(fold, "attachment_id bigint,section bigint,label string,ordinal bigint,text string,content_hash string")


def note_packing(spark: SparkSession, d: str) -> DataFrame:
    """Sections of notes in whole paragraphs up to the target; each text is a state of its own, so no grouping is needed."""
    split = F.udf(lambda s: pack([p.strip() for p in re.split(r"\n\s*\n", s) if p.strip()]), "array<string>", useArrow=True)
    s = table(spark, d, "obsidian_sections").filter("markdown IS NOT NULL").select("section_id", "markdown").distinct()
    return s.select("section_id", F.posexplode(split(T.markdown_plain(F.col("markdown")))).alias("ordinal", "text"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    units = F.udf(evidence_units, "array<struct<start:int,stop:int,unit:string>>", useArrow=True)
    b = table(spark, d, "clean_document_blocks").filter("text IS NOT NULL").select("id", "text").distinct()
    return b.select("id", F.posexplode(units("text")).alias("ordinal", "u")).select("id", "ordinal", "u.*")


def context_packing(spark: SparkSession, d: str) -> DataFrame:
    """The passages of one ranked page into a prompt's budget; the page bounds what is folded."""
    top = table(spark, d, "clean_document_blocks").filter("text IS NOT NULL").dropDuplicates(["id"]).orderBy(F.desc("char_count"), "id").limit(40).select("id", "text", F.col("char_count").alias("n"))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n", "id"], ascending=[False, True])
        p = pack_context(f["text"].tolist(), 24_000)
        return pd.DataFrame({"id": f["id"].iloc[: len(p)], "place": range(1, len(p) + 1), "passage": p})

    return top.groupBy().applyInPandas(fold, "id bigint,place bigint,passage string")


QUERIES = {
    "paragraph_merge": paragraph_merge, "chunk_packing": chunk_packing, "note_packing": note_packing, "evidence_units": evidence, "context_packing": context_packing,
    "citation_numbers": lambda s, d: table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(citations(F.col("text"))).alias("n")),
    "chunk_hash": lambda s, d: table(s, d, "semantic_chunks").select("id", content_hash(F.col("model"), F.lit("v1"), F.col("dimensions"), F.col("text")).alias("hash")).distinct(),
    "context_ladder": lambda s, d: table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.expr("CASE " + " ".join(f"WHEN ceil(length(text) / 2.0) + 2048 <= {k} THEN {k}" for k in (4096, 8192, 16384, 32768, 65536, 131072)) + " END").alias("context")),
}
SQL = {
    "citation_numbers": "SELECT DISTINCT doc_id, unnest(list_transform(string_split(g, ','), lambda x: trim(x)::INTEGER)) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[(\\d{1,3}(?:\\s*,\\s*\\d{1,3})*)\\]', 1)) AS g FROM documents)",
    "chunk_hash": "SELECT DISTINCT id, sha256(concat_ws(chr(0), model, 'v1', dimensions::VARCHAR, text)) AS hash FROM semantic_chunks",
    "context_ladder": "SELECT doc_id, CASE " + " ".join(f"WHEN ceil(length(text) / 2.0) + 2048 <= {k} THEN {k}" for k in (4096, 8192, 16384, 32768, 65536, 131072)) + " END AS context FROM documents WHERE text IS NOT NULL",
}
