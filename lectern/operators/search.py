"""Ranked retrieval: a positional index, BM25, phrases, vectors, fusion and paging.

Statistics (rows, average length, rows per term) are always those of the whole index; filters come after the scores. Query terms and query vectors are
constants of the plan. Texts of hits are joined after the top k.
"""

from __future__ import annotations

import json
import math
import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..session import cut, ensure_checkpoint_dir, spread, table
from ..sinks import generations as G

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
AND_TERMS = 20
#: A bucket of a stored index holds about so many postings, and so does each file of it; there are at least and at most so many buckets.
POSTINGS, LEAST_BUCKETS, MOST_BUCKETS = 5_000_000, 16, 4_096
RRF_BASE = 40
RRF_WEIGHTS = {"phrase": 2.8, "bm25": 1.35, "dense": 1.0}
# What a kind of passage gains or loses in similarity, and in lexical score (lower is better).
KIND_ADJUSTMENT = {"annotation": 0.015, "embedded_annotation": 0.012, "metadata": -0.015, "footnote": -0.012, "table": -0.025, "note": -0.005}
KIND_BOOST = {"annotation": -0.3, "embedded_annotation": -0.2, "obsidian": -0.1}


def index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per document: key, an array of terms per column, and the length over all columns."""
    made = {f"{c}_terms": T.tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns}
    out = spread(df.select(key, *columns)).select(F.col(key).alias("key"), *[e.alias(n) for n, e in made.items()])
    return out.withColumn("n_terms", sum((F.size(n) for n in made), F.lit(0)))


def postings(docs: DataFrame) -> DataFrame:
    """(term, key, column, n, positions) of an index: what is stored once per generation, clustered by term."""
    parts = []
    for c in [x for x in docs.columns if x.endswith("_terms") and x != "n_terms"]:
        e = docs.select("key", F.lit(c[:-6]).alias("column"), F.posexplode(c).alias("position", "term"))
        parts.append(e)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("term", "key", "column").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("position")).alias("positions"))


def _occurrences(terms: str, phrase: list[str]) -> Column:
    t = F.col(terms)
    if len(phrase) == 1:
        return F.size(F.filter(t, lambda x: x == phrase[0]))
    # Terms hold letters and digits only, so the phrase can be sought in the joined terms; a look-ahead counts overlapping ones too.
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(t, "  "), F.lit(" ")), F.lit(f"(?= {'  '.join(phrase)} )"))


def parse(query: str, exact: bool = False) -> list[list[str]]:
    """Phrases of a query: each word, or all words as one. A word with _ is a phrase of its parts."""
    words = re.findall(r"[\wÀ-ž]+", query)
    lower, bare = T.accents()
    parts = [re.findall(r"[^\W_]+", w.lower().translate(str.maketrans(lower, bare))) for w in words]
    parts = [p for p in parts if p]
    return [[x for p in parts for x in p]] if exact and parts else parts[:AND_TERMS]


def bm25(docs: DataFrame, weights: dict[str, float], phrases: list[list[str]], any_term: bool = False) -> DataFrame:
    """(key, score) of documents with all phrases (with any, if any_term); lower scores are better. No phrase, no result."""
    if not phrases:
        return docs.select("key", F.lit(0.0).alias("score")).limit(0)
    found = docs.select("key", "n_terms", *[sum((w * _occurrences(f"{c}_terms", p) for c, w in weights.items()), F.lit(0.0)).alias(f"f{i}") for i, p in enumerate(phrases)], *[sum((_occurrences(f"{c}_terms", p) for c in weights), F.lit(0)).alias(f"o{i}") for i, p in enumerate(phrases)])
    found = cut(found)  # the texts are tokenised once, for the statistics and the scores
    stats = found.agg(F.count(F.lit(1)).alias("n"), F.avg("n_terms").alias("a"), *[F.count_if(F.col(f"o{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    whole = stats.first()  # one row of the whole index; the scores below are constants away from it
    j = found.withColumns({k: F.lit(v) for k, v in whole.asDict().items()})
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
        f = F.col(f"f{i}")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_terms") / F.col("a")))
    hits = [F.col(f"o{i}") > 0 for i in range(len(phrases))]
    keep = hits[0]
    for h in hits[1:]:
        keep = keep | h if any_term else keep & h
    return j.filter(keep).select("key", score.alias("score"))


def write_index(docs: DataFrame, generation: str) -> None:
    """Store an index: postings with each document's length beside them, by bucket of the term and sorted by term, and the index's own statistics.

    Postings of one bucket are written by as many tasks as a hash of the document gives, so a term of all documents is no single task."""
    whole = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("n_terms").alias("a"), F.sum("n_terms").alias("terms")).first()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-(whole["terms"] or 0) // POSTINGS)))
    writers = max(1, -(-(whole["terms"] or 0) // (buckets * POSTINGS)))
    rows = postings(docs).join(docs.select("key", "n_terms"), "key")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    G.write(rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(writers))).sortWithinPartitions("bucket", "term"), generation, "postings", ["bucket"])
    G.write(docs.sparkSession.createDataFrame([(whole["n"], whole["a"], buckets, rows.schema.json())], "n long,a double,buckets int,postings string"), generation, "corpus")


def bm25_stored(spark: SparkSession, generation: str, weights: dict[str, float], phrases: list[list[str]], any_term: bool = False) -> DataFrame:
    """As bm25, from a stored index: only the buckets of the query's terms are read, and no text."""
    whole = spark.read.parquet(f"{generation}/corpus").first()
    stored = spark.read.schema(StructType.fromJson(json.loads(whole["postings"]))).parquet(f"{generation}/postings")  # an empty index has no file to tell its columns
    if not phrases:
        return stored.select("key", F.lit(0.0).alias("score")).limit(0)
    terms = sorted({t for p in phrases for t in p})
    bucket = lambda t: ((h := xxhash.xxh64_intdigest(t, 42)) - (1 << 64 if h >> 63 else 0)) % whole["buckets"]
    own = stored.filter(F.col("bucket").isin(*{bucket(t) for t in terms}) & F.col("term").isin(*terms) & F.col("column").isin(*weights))
    weight = F.element_at(F.create_map(*[F.lit(x) for w in weights.items() for x in w]), F.col("column"))
    parts = []
    for i, p in enumerate(phrases):
        if len(p) == 1:
            hits = own.filter(F.col("term") == p[0]).select("key", "column", "n_terms", F.col("n").alias("o"))
        else:  # the positions of each term, moved to where the phrase begins; common ones are its occurrences
            wanted = own.filter(F.col("term").isin(*p)).groupBy("key", "column", "n_terms").agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{j}") for j, t in enumerate(p)])
            common = F.col("p0")
            for j in range(1, len(p)):
                common = F.array_intersect(common, _moved(f"p{j}", j))
            hits = wanted.dropna().select("key", "column", "n_terms", F.size(common).alias("o")).filter("o > 0")
        parts.append(hits.groupBy("key", "n_terms").agg(F.sum(weight * F.col("o")).alias("f")).withColumn("i", F.lit(i)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    counts = {r["i"]: r["n"] for r in rows.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per phrase
    idf = [max(IDF_FLOOR, x) if (x := math.log((whole["n"] - counts.get(i, 0) + 0.5) / (counts.get(i, 0) + 0.5))) > 0 else IDF_FLOOR for i in range(len(phrases))]
    one = F.element_at(F.array(*map(F.lit, idf)), F.col("i") + 1) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_terms") / F.lit(whole["a"])))
    scored = rows.groupBy("key").agg((-F.sum(one)).alias("score"), F.count_distinct("i").alias("m"))
    return (scored if any_term else scored.filter(F.col("m") == len(phrases))).select("key", "score")


def _moved(column: str, by: int) -> Column:
    return F.transform(column, lambda x: x - by)


def top(scored: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the order (score, key)."""
    return scored.orderBy("score", "key").offset(offset).limit(limit)


def snippet(terms: str, wanted: list[str], width: int = 24) -> Column:
    """The window of terms with most different hits, the first of equals, hits marked."""
    t = F.col(terms)
    starts = F.when(F.size(t) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - width + 1))).otherwise(F.array().cast("array<int>"))
    scored = F.transform(starts, lambda i: F.struct((-F.size(F.array_intersect(F.slice(t, i, width), F.array(*map(F.lit, wanted))))).alias("s"), i.alias("i")))
    best = F.array_min(scored)["i"]
    return F.array_join(F.transform(F.slice(t, best, width), lambda w: F.when(w.isin(*wanted), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " ")


def unit(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def dense(chunks: DataFrame, vector: list[float], k: int, adjust: bool = True) -> DataFrame:
    """(id, kind, item_id, similarity) of the k best; a wrong length raises; ties prefer the larger id."""
    q = F.array(*[F.lit(float(x)) for x in unit(vector)])
    e = F.transform("embedding", lambda x: x.cast("double"))
    plus = lambda a, b: a + b
    dot = F.aggregate(F.zip_with(e, q, lambda a, b: a * b), F.lit(0.0), plus)
    norm = F.sqrt(F.aggregate(F.transform(e, lambda x: x * x), F.lit(0.0), plus))
    s = dot / F.when(norm == 0, 1.0).otherwise(norm)
    checked = chunks.filter(F.assert_true(F.size("embedding") == len(vector), F.lit("embedding of another length")).isNull())
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in KIND_ADJUSTMENT.items() for x in p]), F.col("kind")), F.lit(0.0)) if adjust else F.lit(0.0)
    return checked.select("id", "kind", "item_id", F.round(s + bonus, 9).alias("similarity")).orderBy(F.desc("similarity"), F.desc("id")).limit(k)


def diverse(ranked: DataFrame, limit: int, per_item: int = 2) -> DataFrame:
    """ranked (rank, key, item_id, text) -> the first `limit`, at most per_item of an item and each text once; then filled up with the rest.

    The choice goes row by row, so it runs as one fold, over candidates that a limit has bounded before."""
    import pandas as pd

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank")
        seen, count, first, rest = set(), {}, [], []
        for i, row in enumerate(f.itertuples(index=False)):
            key = None if pd.isna(row.item_id) else row.item_id
            if row.text not in seen and count.get(key, 0) < per_item:
                seen.add(row.text)
                count[key] = count.get(key, 0) + 1
                first.append(i)
            else:
                rest.append(i)
        out = f.iloc[(first + rest)[:limit]].copy()
        out["place"] = range(1, len(out) + 1)
        return out[["place", "rank", "key", "item_id"]]

    return ranked.orderBy("rank").limit(1000).groupBy().applyInPandas(fold, "place long, rank long, key long, item_id long")


def fuse(lists: dict[str, DataFrame]) -> DataFrame:
    """Reciprocal rank fusion of lists (kind, key, rank): (kind, key, score, methods, place); equal scores in the order phrase, BM25, dense and rank.

    A hit is known by kind and key: ids of one kind of record say nothing about another. Lists without kind are of one, null."""
    kind = lambda df: F.col("kind") if "kind" in df.columns else F.lit(None).cast("string").alias("kind")
    parts = [df.select(kind(df), "key", "rank", F.lit(m).alias("method"), F.lit(w).alias("w"), F.lit(i).alias("o")) for i, (m, w) in enumerate(RRF_WEIGHTS.items()) if (df := lists.get(m)) is not None]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    fused = rows.groupBy("kind", "key").agg(F.sum(F.col("w") / (RRF_BASE + F.col("rank"))).alias("s"), F.min(F.struct("o", "rank")).alias("first"), F.array_sort(F.collect_set("method")).alias("methods"))
    return fused.select("kind", "key", F.round("s", 9).alias("score"), F.array_join("methods", ",").alias("methods"), F.row_number().over(Window.orderBy(F.desc(F.round("s", 9)), "first", "kind", "key")).alias("place"))


def near(hits: DataFrame) -> DataFrame:
    """(key, rank) of hits of dense()."""
    return hits.select(F.col("id").alias("key"), F.row_number().over(Window.orderBy(F.desc("similarity"), F.desc("id"))).alias("rank"))


def of_kind(kind: str, df: DataFrame) -> DataFrame:
    return df.withColumn("kind", F.lit(kind))


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """(key, rank) of the best; the window runs over the limited rows only."""
    return top(scored, limit).select("key", F.row_number().over(Window.orderBy("score", "key")).alias("rank"))


def blend(library: DataFrame, vault: DataFrame) -> DataFrame:
    """Five library hits, then one of the vault, and so on: (key, side, place) of lists (key, rank)."""
    a = library.select("key", "rank", F.lit(0).alias("side"), F.ceil(F.col("rank") / 5).alias("block"))
    b = vault.select("key", "rank", F.lit(1).alias("side"), F.col("rank").cast("long").alias("block"))
    return a.unionByName(b).select("key", "side", F.row_number().over(Window.orderBy("block", "side", "rank")).alias("place"))


# --- queries -------------------------------------------------------------------------------------------------------------------------------------

QUERY = "charter survey"
WEIGHTS = {"title": 3.0, "text": 8.0}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return index(table(spark, d, "documents"), "doc_id", ["title", "text"])


def _bm25(spark, d, phrases=None, weights=None, any_term=False) -> DataFrame:
    return bm25(_docs(spark, d), weights or WEIGHTS, parse(QUERY) if phrases is None else phrases, any_term)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("key", F.round("score", 9).alias("score"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Usable chunks of the larger model, once each."""
    c = table(spark, d, "semantic_chunks").filter("model = 'veld-embed-base' AND size(embedding) = dimensions AND forall(embedding, x -> NOT isnan(x) AND abs(x) < float('inf')) AND exists(embedding, x -> x <> 0)")
    return c.select("id", "kind", "item_id", "embedding", "text").dropDuplicates(["id"])


def _vector(spark: SparkSession, d: str) -> list[float]:
    return list(_chunks(spark, d).orderBy("id").limit(1).first()["embedding"])


def dense_topk(spark, d):
    return dense(_chunks(spark, d), _vector(spark, d), 25, adjust=False)


def dense_kind_adjusted(spark, d):
    return dense(_chunks(spark, d), _vector(spark, d), 25)


def dense_diverse(spark, d):
    hits = dense(_chunks(spark, d), _vector(spark, d), 160)
    order = hits.select(F.row_number().over(Window.orderBy(F.desc("similarity"), F.desc("id"))).alias("rank"), F.col("id").alias("key"), "item_id")
    return diverse(order.join(_chunks(spark, d).select(F.col("id").alias("key"), "text"), "key"), 40)


def hybrid(spark, d):
    docs = _docs(spark, d)
    lists = {"phrase": ranked(bm25(docs, WEIGHTS, parse("contested theory", True)), 160), "bm25": ranked(bm25(docs, WEIGHTS, parse("contested theory")), 120)}
    lists = {m: of_kind("document", df) for m, df in lists.items()}
    lists["dense"] = of_kind("chunk", near(dense(_chunks(spark, d), _vector(spark, d), 160)))
    return fuse(lists).filter("place <= 120")


def blend_5_1(spark, d):
    sections = table(spark, d, "obsidian_sections").groupBy(F.col("section_id").alias("key")).agg(F.max(F.struct("heading", "markdown")).alias("r")).select("key", "r.*")
    notes = index(sections, "key", ["heading", "markdown"])
    library = ranked(_bm25(spark, d, parse("survey"), any_term=True), 41).withColumn("key", F.col("key").cast("string"))
    return blend(library, ranked(bm25(notes, {"heading": 2.0, "markdown": 6.0}, parse("survey")), 41))


def bm25_indexed(spark, d):
    """The AND query from an index that is stored in the shared folder first, and removed once its page is taken."""
    root = f"{ensure_checkpoint_dir(spark)}/lectern-index"
    generation = G.reserve(spark, root)
    write_index(_docs(spark, d), generation)
    page = cut(_shown(top(bm25_stored(spark, generation, WEIGHTS, parse(QUERY)), 40)))
    G.remove(spark, generation)
    return page


QUERIES = {
    "bm25_indexed": bm25_indexed,
    "bm25_and": lambda s, d: _shown(top(_bm25(s, d), 40)),
    "bm25_or_locate": lambda s, d: _shown(top(_bm25(s, d, any_term=True), 40)),
    "bm25_page_two": lambda s, d: _shown(top(_bm25(s, d, any_term=True), 40, 40)),
    "bm25_text_only": lambda s, d: _shown(top(bm25(index(table(s, d, "documents"), "doc_id", ["text"]), {"text": 1.0}, parse(QUERY)), 40)),
    "bm25_filtered": lambda s, d: _shown(_bm25(s, d, any_term=True).join(table(s, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("key")), "key", "left_semi")),
    "phrase_exact": lambda s, d: _shown(top(_bm25(s, d, parse("contested theory", True)), 40)),
    "term_stats": lambda s, d: postings(_docs(s, d)).groupBy("term").agg(F.count_distinct("key").alias("n_docs"), F.sum("n").alias("n_total")),
    "doc_stats": lambda s, d: _docs(s, d).select("key", F.col("n_terms").cast("long").alias("n_terms")),
    "postings": lambda s, d: postings(_docs(s, d)).select("term", "key", "column", "n", F.element_at("positions", 1).cast("long").alias("first")),
    "snippet": lambda s, d: index(table(s, d, "documents"), "doc_id", ["text"]).filter(F.exists("text_terms", lambda t: t == "survey")).select("key", snippet("text_terms", ["charter", "survey"]).alias("snippet")),
    "dense_topk": dense_topk, "dense_kind_adjusted": dense_kind_adjusted, "dense_diverse": dense_diverse, "rrf_hybrid": hybrid, "blend_5_1": blend_5_1,
}

_fold = lambda x: f"regexp_extract_all(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '\\p{{Mn}}+', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"


def bm25_sql(phrases: list[list[str]], weights: dict[str, float], tail: str, any_term: bool = False, source: str = "SELECT *, doc_id AS key FROM documents", digits: int = 9) -> str:
    count = lambda c, p: f"len(list_filter({c}_t, lambda x: x = '{p[0]}'))" if len(p) == 1 else f"len(list_filter(range(1, len({c}_t) + 1), lambda i: {c}_t[i:i + {len(p) - 1}] = {p!r}))"
    n = range(len(phrases))
    score = " ".join(f"- (CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in n)
    return (
        f"WITH t AS (SELECT key, {', '.join(f'{_fold(c)} AS {c}_t' for c in weights)} FROM ({source}) src), "
        f"f AS (SELECT key, {' + '.join(f'len({c}_t)' for c in weights)} AS l, {', '.join(' + '.join(f'{w}::DOUBLE * {count(c, p)}' for c, w in weights.items()) + f' AS f{i}, ' + ' + '.join(count(c, p) for c in weights) + f' AS o{i}' for i, p in enumerate(phrases))} FROM t), "
        f"s AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a, {', '.join(f'count_if(o{i} > 0) AS n{i}' for i in n)} FROM f), "
        f"r AS (SELECT key, 0.0::DOUBLE {score} AS x FROM f, s WHERE {(' OR ' if any_term else ' AND ').join(f'o{i} > 0' for i in n)}) "
        f"SELECT key, round(x, {digits}) AS score FROM r {tail}"
    )


_sql = bm25_sql
_TWO = [["charter"], ["survey"]]
_OK = "SELECT DISTINCT ON (id) id, kind, item_id, embedding::DOUBLE[] AS e FROM semantic_chunks WHERE model = 'veld-embed-base' AND len(embedding) = dimensions AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_BONUS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in KIND_ADJUSTMENT.items()) + " ELSE 0 END"
_dense = lambda bonus: f"WITH c AS ({_OK}), q AS (SELECT e AS v FROM c ORDER BY id LIMIT 1) SELECT id, kind, item_id, round(list_cosine_similarity(e, v) + {bonus}, 9) AS similarity FROM c, q ORDER BY similarity DESC, id DESC LIMIT 25"
_POST = f"WITH t AS (SELECT doc_id AS key, 'title' AS \"column\", {_fold('title')} AS t FROM documents UNION ALL SELECT doc_id, 'text', {_fold('text')} FROM documents), p AS (SELECT key, \"column\", unnest(t) AS term, generate_subscripts(t, 1) - 1 AS position FROM t) "
SQL = {
    "bm25_indexed": _sql(_TWO, WEIGHTS, "ORDER BY x, key LIMIT 40"),
    "bm25_and": _sql(_TWO, WEIGHTS, "ORDER BY x, key LIMIT 40"),
    "bm25_or_locate": _sql(_TWO, WEIGHTS, "ORDER BY x, key LIMIT 40", True),
    "bm25_page_two": _sql(_TWO, WEIGHTS, "ORDER BY x, key LIMIT 40 OFFSET 40", True),
    "bm25_text_only": _sql(_TWO, {"text": 1.0}, "ORDER BY x, key LIMIT 40"),
    "bm25_filtered": _sql(_TWO, WEIGHTS, "WHERE key IN (SELECT doc_id FROM documents WHERE lang = 'en')", True),
    "phrase_exact": _sql([["contested", "theory"]], WEIGHTS, "ORDER BY x, key LIMIT 40"),
    "term_stats": _POST + "SELECT term, count(DISTINCT key) AS n_docs, count(*) AS n_total FROM p GROUP BY term",
    "doc_stats": f"SELECT doc_id AS key, len({_fold('title')}) + len({_fold('text')}) AS n_terms FROM documents",
    "postings": _POST + 'SELECT term, key, "column", count(*) AS n, min(position) AS first FROM p GROUP BY ALL',
    "dense_topk": _dense("0"), "dense_kind_adjusted": _dense(_BONUS),
}
_ranked = lambda sql, n: f"SELECT key, row_number() OVER (ORDER BY score, key) AS rank FROM ({sql}) ORDER BY score, key LIMIT {n}"
_CONTESTED = _sql([["contested"], ["theory"]], WEIGHTS, "", digits=15), _sql([["contested", "theory"]], WEIGHTS, "", digits=15)
_NEAR = f"WITH c AS ({_OK}), q AS (SELECT e AS v FROM c ORDER BY id LIMIT 1) SELECT id AS key, row_number() OVER (ORDER BY round(list_cosine_similarity(e, v) + {_BONUS}, 9) DESC, id DESC) AS rank FROM c, q QUALIFY rank <= 160"
_LISTS = " UNION ALL ".join(f"SELECT '{kind}' AS kind, key, rank, '{m}' AS method, {RRF_WEIGHTS[m]}::DOUBLE AS w, {i} AS o FROM ({sql})" for i, (m, kind, sql) in enumerate((("phrase", "document", _ranked(_CONTESTED[1], 160)), ("bm25", "document", _ranked(_CONTESTED[0], 120)), ("dense", "chunk", _NEAR))))
_SECTIONS = "SELECT section_id AS key, any_value(heading) AS heading, any_value(markdown) AS markdown FROM obsidian_sections GROUP BY section_id"
SQL["rrf_hybrid"] = f"""WITH l AS ({_LISTS}), g AS (SELECT kind, key, round(sum(w / ({RRF_BASE} + rank)), 9) AS score, min({{'o': o, 'r': rank}}) AS first, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM l GROUP BY kind, key)
SELECT kind, key, score, methods, row_number() OVER (ORDER BY score DESC, first, kind, key)::INTEGER AS place FROM g QUALIFY place <= 120"""
SQL["blend_5_1"] = f"""WITH a AS (SELECT key::VARCHAR AS key, rank, 0 AS side, ceil(rank / 5) AS block FROM ({_ranked(_sql([["survey"]], WEIGHTS, "", True, digits=15), 41)})), b AS (SELECT key, rank, 1 AS side, rank AS block FROM ({_ranked(_sql([["survey"]], {"heading": 2.0, "markdown": 6.0}, "", source=_SECTIONS, digits=15), 41)}))
SELECT key, side, row_number() OVER (ORDER BY block, side, rank)::INTEGER AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""
