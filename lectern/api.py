"""Library: requests to lazy DataFrames."""

from __future__ import annotations

import json
import re
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as T
from .operators import indexes as I, search as S
from .plans import relational as R
from .session import table
from .sinks import generations as G


@dataclass(frozen=True)
class Filters:
    """None means no restriction, an empty tuple nothing. Collections (0: items in none) and days of publication and addition hold for records of items, folders for those of the vault."""

    collections: tuple[int, ...] | None = None
    folders: tuple[str, ...] | None = None
    published_from: str | None = None
    published_to: str | None = None
    offset: int = 0
    added_from: str | None = None
    added_to: str | None = None

    @classmethod
    def parse(cls, raw: dict) -> Filters:
        """Lists may be JSON texts; numbers are clamped at 0; days that aren't YYYY-MM-DD are dropped."""

        def many(v, kind):
            if v is None:
                return None
            v = json.loads(v) if isinstance(v, str) else v
            return tuple(kind(x) for x in v)

        def day(v):
            return v if isinstance(v, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", v) else None

        try:
            offset = max(0, int(raw.get("offset", 0)))
        except (TypeError, ValueError):
            offset = 0
        return cls(many(raw.get("collections"), int), many(raw.get("folders"), str), day(raw.get("from")), day(raw.get("to")), offset, day(raw.get("added_from")), day(raw.get("added_to")))


class Cache:
    """The latest answers' evidence: SIZE entries for TTL seconds, the oldest goes first."""

    SIZE, TTL = 20, 3600.0

    def __init__(self, clock: Callable[[], float] = time.time):
        self._rows: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self._clock = clock

    def put(self, key: str, value: object) -> None:
        self._rows.pop(key, None)
        self._rows[key] = (self._clock(), value)
        while len(self._rows) > self.SIZE:
            self._rows.popitem(last=False)

    def get(self, key: str):
        at, value = self._rows.get(key, (0.0, None))
        if value is not None and self._clock() - at > self.TTL:
            del self._rows[key]
            return None
        return value


class Library:
    """A library's tables under one folder. embed: query text to vector; without it, dense and hybrid requests fall back to BM25 with a reason.

    indexes: folder of the stored lexical indexes (refresh() fills it); requests read what is published there."""

    PAGE = 40

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[str], list[float]] | None = None, indexes: str | None = None):
        self.spark, self.root, self.embed, self.indexes = spark, root, embed, indexes
        self.reason: str | None = None

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def _items(self, filters: Filters) -> DataFrame | None:
        """item_id of the items that pass; None without a restriction. An item without a readable date passes no restriction of days."""
        if filters.collections is None and not any((filters.published_from, filters.published_to, filters.added_from, filters.added_to)):
            return None
        out = self._table("items").select(F.col("id").alias("item_id"), "collections_json", "date_added")
        if filters.collections is not None:
            c = F.coalesce(F.from_json("collections_json", "array<bigint>"), F.array().cast("array<bigint>"))
            inside = F.arrays_overlap(c, F.array(*map(F.lit, filters.collections))) if filters.collections else F.lit(False)
            out = out.filter(inside | (F.size(c) == 0) if 0 in filters.collections else inside)
        if filters.added_from or filters.added_to:
            out = out.filter(F.substring("date_added", 1, 10).between(filters.added_from or "", filters.added_to or "9999-12-31"))
        out = out.select("item_id").distinct()
        if filters.published_from or filters.published_to:
            days = R.run(self.spark, self.root, "date_interval")
            days = days.filter((F.col("hi") >= (filters.published_from or "")) & (F.col("lo") <= (filters.published_to or "9999-12-31")))
            out = out.join(days.select(F.col("id").alias("item_id")), "item_id", "left_semi")
        return out

    def _chunks(self, filters: Filters, allowed: DataFrame | None) -> DataFrame:
        """Usable chunks that pass, before any top k. Where the table has no column folder, no vault chunk passes a restriction of folders."""
        chunks, vault = S._chunks(self.spark, self.root), F.coalesce(F.col("kind") == "obsidian", F.lit(False))
        if allowed is not None:
            chunks = chunks.filter(vault).unionByName(chunks.filter(~vault).join(allowed, "item_id", "left_semi").select(chunks.columns))
        if filters.folders is not None:
            named = self._table("semantic_chunks")
            if filters.folders and "folder" in named.columns:
                inside = named.filter(F.col("folder").isin(*filters.folders)).select("id")
                chunks = chunks.filter(~vault).unionByName(chunks.filter(vault).join(inside, "id", "left_semi").select(chunks.columns))
            else:
                self.reason = "chunks without folders" if filters.folders else self.reason
                chunks = chunks.filter(~vault)
        return chunks

    def search(self, query: str, method: str = "hybrid", exact: bool = False, filters: Filters = Filters()) -> DataFrame:
        """(kind, key, score, title) of a page of documents and chunks, best first; titles are joined per kind after the top k."""
        method = method if method in ("bm25", "dense", "hybrid") else "hybrid"
        self.reason = None
        if method != "bm25" and self.embed is None:
            method, self.reason = "bm25", "no embedding service"
        docs = S.index(self._table("documents"), "doc_id", ["title", "text"])
        scored = S.bm25(docs, S.WEIGHTS, S.parse(query, exact and method == "bm25"))
        allowed, target = self._items(filters), filters.offset + self.PAGE + 1
        keys = None if allowed is None else self._table("documents").join(allowed, "item_id", "left_semi").select(F.col("doc_id").alias("key"))
        kept = lambda scored: scored if keys is None else scored.join(keys, "key", "left_semi")
        scored = kept(scored)
        if method == "bm25":
            page = S.of_kind("document", S.top(scored, self.PAGE + 1, filters.offset))
        else:
            candidates = target if method == "dense" else min(500, max(100, 3 * target))
            near = S.dense(self._chunks(filters, allowed), self.embed(query), max(160, 2 * candidates))
            if method == "dense":
                page = S.of_kind("chunk", near.select(F.col("id").alias("key"), (-F.col("similarity")).alias("score"))).orderBy("score", F.desc("key")).offset(filters.offset).limit(self.PAGE + 1)
            else:
                lists = {"bm25": S.of_kind("document", S.ranked(scored, candidates)), "dense": S.of_kind("chunk", S.near(near))}
                if 1 <= len(S.parse(query)) <= 6:
                    lists["phrase"] = S.of_kind("document", S.ranked(kept(S.bm25(docs, S.WEIGHTS, S.parse(query, True))), min(candidates, 160)))
                page = S.fuse(lists).orderBy("place").offset(filters.offset).limit(self.PAGE + 1).select("kind", "key", (-F.col("score")).alias("score"), "place")
        titles = S.of_kind("document", self._table("documents").select(F.col("doc_id").alias("key"), "title"))
        if method != "bm25":
            titles = titles.unionByName(S.of_kind("chunk", self._table("semantic_chunks").select(F.col("id").alias("key"), "title").dropDuplicates(["key"])))
        order = ["place"] if "place" in page.columns else ["score", F.desc("key") if method == "dense" else "key"]
        return page.join(titles, ["kind", "key"], "left").orderBy(*order).select("kind", "key", "score", "title")

    def refresh(self) -> dict:
        """Store the lexical indexes anew and publish them; generations that no pointer names go."""
        manifest = I.build(self.spark, self.root, self.indexes)
        G.recover(self.spark, self.indexes)
        return manifest

    def lexical(self, query: str, scope: str = "all", exact: bool = False, filters: Filters = Filters()) -> DataFrame:
        """(kind, key, score, place) of a page over all lexical indexes of the scope, from the published generation if there is one."""
        published = G.current(self.spark, self.indexes) if self.indexes else None
        last = filters.offset + self.PAGE + 1
        found = I.hits(self.spark, self.root, query, last, scope, exact, published["generation"] if published else None, self._items(filters), filters.folders)
        return found.filter(F.col("place") > filters.offset).orderBy("place")

    def author(self, name: str) -> DataFrame:
        people = F.from_json("creators_json", T.CREATORS)
        return self._table("items").filter(F.exists(people, lambda p: F.lower(F.trim(F.concat_ws(" ", p["firstName"], p["lastName"]))) == name.strip().lower())).select("id", "title").distinct()

    def pages(self, attachment_id: int, start: int = 1, limit: int = 30) -> DataFrame:
        limit = min(30, max(1, limit))
        return self._table("document_pages").filter((F.col("attachment_id") == attachment_id) & (F.col("page_number") >= start)).select("id", "page_number", "text").distinct().orderBy("page_number", "id").limit(limit)

    def item(self, item_id: int) -> DataFrame:
        a = self._table("document_pages").filter(F.col("item_id") == item_id).groupBy("item_id").agg(F.array_sort(F.collect_set("attachment_id")).alias("attachments"))
        return self._table("items").filter(F.col("id") == item_id).distinct().join(a.withColumnRenamed("item_id", "id"), "id", "left")
