"""Problem 7: the K most similar embeddings of the same model for every embedding.

Equal embeddings are one node; what a node needs of its rows are the K + 1 smallest ids, taken by a group limit that runs before the shuffle. Nodes
go to the shard of their nearest centroid; centroids are fitted per model on a sample of SAMPLE nodes (the first by hash of the id), at most MAX_CENTROIDS. The cell
of a centroid with more than MAX_SHARD nodes gets centroids of its own, fitted on a sample of SAMPLE of its nodes, so shards keep their size up to MAX_LEAVES of them
(1.3 billion nodes); only a shard that is still too large is divided at random into parts, and all of them are asked. Each part gets one HNSW graph (hnsw) over its nodes, built once:
its nodes come first in their task, then those that ask it come in batches. Every node is searched in the
shards of its PROBES nearest centroids, and the shards' results are merged. Cosines of what the graphs return are recomputed in double precision from the
stored embeddings. What is broadcast are the centroids: MAX_LEAVES vectors at most.

All rows are indexed and all are queries. Usable are embeddings whose length equals dimensions, with all values finite and not all zero; others have no
neighbours. Rows without id or model are left out; re-delivered rows count once (of rows with one id and other content, the smallest). Ties go to the smaller id. A
model with one usable row gives no pairs. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut, table
from ..skew import skew_join
from . import hnsw

K = 5
#: Neighbour nodes kept for each node; more than K because of ties.
NODES = 10
SHARD = 4_000
PROBES = 3
SAMPLE = 8_192
MAX_CENTROIDS = 1_024
#: A shard is divided beyond so many nodes.
MAX_SHARD = 20_000
#: Centroids of both levels that are broadcast, of all models together (at 96 dimensions 50 MB).
MAX_LEAVES = 131_072


def usable(df: DataFrame) -> DataFrame:
    """(id, model, embedding) of usable rows, one per id."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = df.filter(F.col("id").isNotNull() & F.col("model").isNotNull() & (F.size(e) == F.col("dimensions")) & finite & F.exists(e, lambda x: x != 0))
    return ok.select("id", "model", e.cast("array<float>").alias("embedding")).groupBy("id").agg(F.min(F.struct("model", "embedding")).alias("r")).select("id", "r.*")


def _unit(x: pd.Series) -> np.ndarray:
    v = np.stack(x.to_numpy()).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # squares of very large or small values would not be finite
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def fitted(nodes: DataFrame, wanted: dict[tuple, int], keys: list[str]) -> dict[tuple, np.ndarray]:
    """By key: unit vectors, fitted by spherical k-means on the first SAMPLE nodes of each key by hash. Nodes of other keys are left out."""
    w = Window.partitionBy(*keys).orderBy("h", "node")
    some = nodes.withColumn("h", F.xxhash64("node")).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= SAMPLE)

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        key = tuple(f[k].iloc[0] for k in keys)
        x = _unit(f.sort_values(["h", "node"])["embedding"]).astype(np.float32)
        k = min(len(x), wanted.get(key, 1))
        c = x[:k].copy()
        for _ in range(8):
            home = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, home, x)
            norm = np.linalg.norm(sums, axis=1)
            c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], c)
        return pd.DataFrame({**dict(zip(keys, key)), "c": np.arange(k), "v": list(c)})

    kinds = ",".join(f"{k} {nodes.schema[k].dataType.simpleString()}" for k in keys)
    rows = some.groupBy(*keys).applyInPandas(fit, f"{kinds},c int,v array<float>").toPandas()
    return {k if isinstance(k, tuple) else (k,): np.stack(g.sort_values("c")["v"].to_numpy()) for k, g in rows.groupby(keys)}


class Router:
    """Shards of unit vectors: cells of the first level, each of them one shard or divided by centroids of its own."""

    def __init__(self, tops: np.ndarray, leaves: dict[int, np.ndarray]):
        self.tops = tops
        parts = [leaves.get(c, tops[c : c + 1]) for c in range(len(tops))]
        self.leaves, self.begin = np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, <= probes) shards, the nearest first; those of the 2 * probes nearest cells are compared."""
        s = x @ self.tops.T
        if len(self.leaves) == len(self.tops):
            return np.argsort(-s, axis=1, kind="stable")[:, :probes]
        cells = np.argsort(-s, axis=1, kind="stable")[:, : 2 * probes]
        best = np.full((len(x), probes), -np.inf, np.float32)
        ids = np.full((len(x), probes), -1, np.int64)
        for c in np.unique(cells):
            rows = np.flatnonzero((cells == c).any(1))
            own = np.arange(self.begin[c], self.begin[c + 1])
            some = np.concatenate([best[rows], x[rows] @ self.leaves[own].T], 1)
            names = np.concatenate([ids[rows], np.broadcast_to(own, (len(rows), len(own)))], 1)
            pick = np.argsort(-some, axis=1, kind="stable")[:, :probes]
            best[rows], ids[rows] = np.take_along_axis(some, pick, 1), np.take_along_axis(names, pick, 1)
        return ids[:, : min(probes, len(self.leaves))]


def routers(nodes: DataFrame) -> tuple[dict[tuple, Router], int]:
    """By (model, length), and the number of shards."""
    counts = {(r["model"], r["size"]): r["n"] for r in nodes.groupBy("model", "size").agg(F.count(F.lit(1)).alias("n")).collect()}
    tops = fitted(nodes, {k: int(min(MAX_CENTROIDS, -(-n // SHARD))) for k, n in counts.items()}, ["model", "size"])
    leaves: dict[tuple, np.ndarray] = {}
    if any(n > MAX_SHARD for n in counts.values()):
        shared = nodes.sparkSession.sparkContext.broadcast(tops)

        def home(frames):
            for f in frames:
                cell = np.zeros(len(f), np.int32)
                for key, at in f.groupby(["model", "size"]).indices.items():
                    cell[at] = (_unit(f["embedding"].iloc[at]).astype(np.float32) @ shared.value[key].T).argmax(1)
                yield f[["node", "model", "size", "embedding"]].assign(cell=cell)

        placed = cut(nodes.mapInPandas(home, "node bigint,model string,size int,embedding array<float>,cell int"))
        large = {(r["model"], r["size"], r["cell"]): r["n"] for r in placed.groupBy("model", "size", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_SHARD).collect()}
        if large:
            most = max(1, MAX_LEAVES // len(large))
            keys = ["model", "size", "cell"]
            inside = placed.join(F.broadcast(nodes.sparkSession.createDataFrame(list(large), "model string,size int,cell int")), keys)  # at most MAX_CENTROIDS rows per model
            leaves = fitted(inside, {k: int(min(most, -(-2 * n // MAX_SHARD))) for k, n in large.items()}, keys)
    made = {k: Router(c, {cell: v for (*key, cell), v in leaves.items() if tuple(key) == k}) for k, c in tops.items()}
    return made, sum(len(r.leaves) for r in made.values())


def part_results(inside: pd.DataFrame):
    """The graph of a part's nodes, as a function from a batch of asking nodes to (node, other, cos)."""
    order, sizes = hnsw.level_order(inside["node"].to_numpy())
    inside = inside.iloc[order]
    exact, names = _unit(inside["embedding"]), inside["node"].to_numpy()
    graph = hnsw.Graph(exact.astype(np.float32), sizes)

    def ask(queries: pd.DataFrame) -> pd.DataFrame:
        q, asked = _unit(queries["embedding"]), queries["node"].to_numpy()
        at, _ = graph.search(q.astype(np.float32), NODES + 1)
        row, col = np.nonzero(at >= 0)
        other = at[row, col]
        cos = np.einsum("ij,ij->i", q[row], exact[other])
        keep = names[other] != asked[row]
        return pd.DataFrame({"node": asked[row][keep], "other": names[other][keep], "cos": cos[keep]})

    return ask


def search(frames):
    """Rows come by part, those stored in it first: its graph is built once, asked by its own nodes, then by batches of others."""
    key, held, ask = None, [], None
    step = 4096

    def built():
        nonlocal ask
        inside = pd.concat(held)
        ask = part_results(inside)
        for i in range(0, len(inside), step):
            yield ask(inside.iloc[i : i + step])

    for f in frames:
        for own, g in f.groupby(["model", "size", "shard", "part"], sort=False):
            if own != key:
                if held and ask is None:
                    yield from built()
                key, held, ask = own, [], None
            stored, asks = g[g["stored"]], g[~g["stored"]]
            if len(stored):
                held.append(stored)
            if len(asks) and held:
                if ask is None:
                    yield from built()
                for i in range(0, len(asks), step):
                    yield ask(asks.iloc[i : i + step])
    if held and ask is None:
        yield from built()


def node_neighbours(nodes: DataFrame) -> DataFrame:
    """nodes (node, model, embedding) of distinct embeddings -> (node, other, cos), at most NODES best each."""
    spark = nodes.sparkSession
    nodes = nodes.withColumn("size", F.size("embedding"))
    made, shards = routers(nodes)
    shared = spark.sparkContext.broadcast(made)

    def route(frames):
        for f in frames:
            out = []
            for key, g in f.groupby(["model", "size"]):
                best = shared.value[key].nearest(_unit(g["embedding"]).astype(np.float32), PROBES)
                for j in range(best.shape[1]):
                    out.append(g.assign(shard=best[:, j], home=j == 0)[best[:, j] >= 0])
            if out:
                yield pd.concat(out)

    routed = cut(nodes.mapInPandas(route, "node bigint,model string,embedding array<float>,size int,shard int,home boolean"))
    # A row per shard: at most MAX_LEAVES and one more for each centroid of the first level.
    parts = routed.groupBy("model", "size", "shard").agg(F.count_if("home").alias("n")).filter(F.col("n") > 0).withColumn("parts", F.ceil(F.col("n") / MAX_SHARD).cast("int")).drop("n")
    r = routed.join(F.broadcast(parts), ["model", "size", "shard"])
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cols = ["node", "model", "embedding", "size", "shard"]
    stored = r.filter("home").select(*cols, own.alias("part"), F.lit(True).alias("stored"))
    asking = r.filter("NOT home OR parts > 1").select(*cols, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("stored"), F.when(F.col("home"), own).alias("own"))
    asking = asking.filter("own IS NULL OR own <> part").drop("own")  # a node asks its own part as one of the stored
    keys = ["model", "size", "shard", "part"]
    tasks = max(spark.sparkContext.defaultParallelism, shards)
    grouped = stored.unionByName(asking).repartition(tasks, *keys).sortWithinPartitions(*keys, F.desc("stored"))
    found = grouped.mapInPandas(search, "node bigint,other bigint,cos double")
    w = Window.partitionBy("node").orderBy(F.desc(F.round("cos", 9)), "other")
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= NODES).drop("rn")


def neighbours(df: DataFrame, k: int = K) -> DataFrame:
    """(id, other_id, cos, rank): for every usable row its k most similar rows of the same model."""
    rows = usable(df).withColumn("h1", F.xxhash64("model", "embedding")).withColumn("h2", F.xxhash64("embedding", "model", F.lit(1)))
    rows = cut(rows)
    w = Window.partitionBy("h1", "h2").orderBy("id")
    first = rows.select("id", "h1", "h2").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1)
    groups = cut(first.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("node", F.element_at("ids", 1)))
    nodes = groups.select("node").join(rows.withColumnRenamed("id", "node"), "node").select("node", "model", "embedding")
    near = cut(node_neighbours(nodes))
    # Candidates of a node: at most NODES neighbours with at most k + 1 ids each.
    ids = groups.select(F.col("node").alias("other"), "ids")
    near = skew_join(near, ids, ["other"]).select("node", F.explode("ids").alias("other_id"), "cos")
    candidates = near.groupBy("node").agg(F.collect_list(F.struct(F.round("cos", 9).alias("cos"), "other_id")).alias("near"))
    placed = skew_join(rows.select("id", "h1", "h2"), groups, ["h1", "h2"]).select("id", "node", "ids")
    full = F.size("ids") > k  # k equal rows beside itself: no other is needed
    twins = F.transform(F.filter("ids", lambda x: x != F.col("id")), lambda x: F.struct(F.lit(1.0).alias("cos"), x.alias("other_id")))
    some = placed.filter(~full).join(candidates, "node", "left").select("id", F.concat(twins, F.coalesce("near", F.array().cast("array<struct<cos:double,other_id:bigint>>"))).alias("c"))
    every = placed.filter(full).select("id", twins.alias("c")).unionByName(some)
    best = F.slice(F.array_sort(F.transform("c", lambda x: F.struct((-x["cos"]).alias("d"), x["other_id"].alias("other_id")))), 1, k)
    return every.select("id", F.posexplode(best).alias("p", "x")).select("id", F.col("x.other_id").alias("other_id"), (-F.col("x.d")).alias("cos"), (F.col("p") + 1).alias("rank"))


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "semantic_chunks"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = neighbours(table(spark, sf_dir, "semantic_chunks"))
    return n.select(F.least("id", "other_id").alias("chunk_a"), F.greatest("id", "other_id").alias("chunk_b")).distinct()


QUERIES = {"p7_found": p7_found, "p7_neighbours": p7_neighbours}
_NEAR = """WITH c AS (SELECT DISTINCT ON (id) id, model, embedding::DOUBLE[] AS e FROM semantic_chunks WHERE len(embedding) = dimensions
  AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS x, b.id AS y, round(list_cosine_similarity(a.e, b.e), 9) AS cos, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.id) AS rn FROM c a JOIN c b ON a.model = b.model AND a.id <> b.id)
"""
SQL = {"p7_found": _NEAR + "SELECT DISTINCT least(x, y) AS chunk_a, greatest(x, y) AS chunk_b FROM s WHERE rn <= 5", "p7_neighbours": _NEAR + "SELECT x AS id, y AS other_id, cos, rn::INTEGER AS rank FROM s WHERE rn <= 5"}
