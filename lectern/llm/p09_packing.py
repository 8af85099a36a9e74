"""Problem 9: documents into containers of fixed capacity, in tokens of a public tokenizer.

Only the histogram of sizes reaches the driver: at most `capacity` rows, whatever the number of documents. Sizes are routed to TIERS context sizes, each half
of the one before: a document belongs to the smallest window that holds it. Tiers are packed from the longest on: each opens windows for what is left
of its documents, and the gaps of these windows are filled from the shorter tiers, the longest document that fits into the tightest gap first. The shortest tier packs
its rest by best fit decreasing. A container holds one window of the longest tier or 2, 4, 8 of a shorter one, the costly with the cheap;
what is left over of each tier shares containers. Where windows of the shortest tier would cost containers, as few short documents fill them up, there are fewer tiers. Containers of a tier are dealt to that tier's step groups to and fro by cost (sum of squared sizes), which balances the groups.
Windows of one pattern are planned together as a count. Documents find their place by their rank among those of their size: ranks come from counts per
(size, bucket), so a hot size is spread over buckets.

A document longer than the capacity is cut into full containers and a rest; nothing else is cut. Null and empty texts have no tokens and
take no room: they stand in container 0. Repeated rows are packed as often as they stand; rows with a null id are packed too. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut, table
from . import p08_tokens as tokens

CAPACITY = 2048
TIERS = 4
#: Containers a step takes at once.
STEP = 8
#: A bucket of one size holds about so many documents.
BUCKET_ROWS = 50_000


class Windows:
    """Windows of one size, those of one pattern ((size, each), ...) counted together, found by their gap."""

    def __init__(self, width: int):
        self.width = width
        self.open: dict[int, list] = defaultdict(list)
        self.gaps: list[int] = []

    def put(self, gap: int, n: int, pattern: tuple) -> None:
        if gap not in self.open:
            bisect.insort(self.gaps, gap)
        for x in self.open[gap]:
            if x[1] == pattern:
                x[0] += n
                return
        self.open[gap].append([n, pattern])

    def place(self, size: int, left: int, may_open: bool) -> int:
        """Documents of one size into the tightest gaps, and into new windows if there may be; how many are left."""
        while left:
            i = bisect.bisect_left(self.gaps, size)
            if i < len(self.gaps):
                gap = self.gaps[i]
                n, pattern = self.open[gap].pop()
                if not self.open[gap]:
                    del self.open[gap]
                    self.gaps.pop(i)
            elif may_open:
                gap, n, pattern = self.width, -(-left // (self.width // size)), ()
            else:
                break
            each = min(gap // size, left)
            full = min(n, left // each)
            self.put(gap - each * size, full, (*pattern, (size, each)))
            left -= full * each
            if n > full and left and left < each:  # what is left over goes into one window of the same kind
                self.put(gap - left * size, 1, (*pattern, (size, left)))
                full, left = full + 1, 0
            if n > full and pattern:
                self.put(gap, n - full, pattern)
        return left


@dataclass
class Plan:
    """rows (tier, size, first, count, base, each, offset): documents of that size with ranks first .. first+count-1 go to the tier's windows from base on, `each` per window.

    whole: containers that hold windows of one tier, by tier; their numbers begin at first. Windows beyond them: their container and where they start, by (tier, window)."""

    widths: list[int]
    rows: pd.DataFrame
    whole: list[int]
    first: list[int]
    rest: dict[tuple[int, int], tuple[int, int]]
    containers: int

    def windows(self, tier: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Container and start of windows, which a tier numbers by falling cost: dealt to its containers to and fro, so costly ones go with cheap ones."""
        whole, first, width = (np.array(x)[tier] for x in (self.whole, self.first, self.widths))
        inside = window < whole << tier
        at = np.maximum(whole, 1)
        lap, at = window // at, window % at
        container, start = first + np.where(lap % 2 == 0, at, whole - 1 - at), lap * width
        for i in np.flatnonzero(~inside):
            container[i], start[i] = self.rest[int(tier[i]), int(window[i])]
        return container, start


def plan(histogram: dict[int, int], capacity: int, tiers: int = TIERS) -> Plan:
    """The most tiers, up to `tiers`, that need no more containers than fewer would: windows that no short documents fill up would waste room."""
    return min((tiered(histogram, capacity, t) for t in range(tiers, 0, -1)), key=lambda p: p.containers)


def tiered(histogram: dict[int, int], capacity: int, tiers: int) -> Plan:
    widths = [capacity >> t for t in range(tiers) if capacity >> t]
    left = {s: n for s, n in histogram.items() if s > 0}
    rank, rows, counts = defaultdict(int), [], []
    for t, width in enumerate(widths):
        low = widths[t + 1] if t + 1 < len(widths) else 0
        w = Windows(width)
        for size in sorted(left, reverse=True):
            left[size] = w.place(size, left[size], size > low)
        groups = sorted(((sum(e * s * s for s, e in p), n, p) for g in w.open.values() for n, p in g), key=lambda g: (-g[0], g[2]))
        base = 0
        for _, n, pattern in groups:
            offset = 0
            for size, each in pattern:
                rows.append((t, size, rank[size], n * each, base, each, offset))
                rank[size] += n * each
                offset += size * each
            base += n
        counts.append(base)
    whole = [n >> t for t, n in enumerate(counts)]
    first = [sum(whole[:t]) for t in range(len(whole))]
    rest, container, used = {}, sum(whole), 0
    for t, n in enumerate(counts):
        for window in range(whole[t] << t, n):
            if used + widths[t] > capacity:
                container, used = container + 1, 0
            rest[t, window] = (container, used)
            used += widths[t]
    frame = pd.DataFrame(rows, columns=["tier", "size", "first", "count", "base", "each", "offset"]).astype("int64")
    return Plan(widths, frame, whole, first, rest, container + (used > 0))


def packed(sizes: DataFrame, capacity: int = CAPACITY, step: int = STEP, tiers: int = TIERS) -> DataFrame:
    """sizes (doc_id, n_tokens) -> (doc_id, piece, container_id, position, n_tokens, tier, step_group). tier: the size of the window it stands in."""
    spark = sizes.sparkSession
    n = F.coalesce("n_tokens", F.lit(0))
    whole = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int")
    pieces = sizes.select("doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"), n.alias("n"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("size"))
    some = pieces.filter("size > 0")
    found = {r["size"]: r["n"] for r in some.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = plan(found, capacity, tiers)
    # Step groups are numbered through the tiers; what is shared by tiers has groups of its own.
    ends = [*made.first, sum(made.whole), made.containers]
    steps = [-(-(z - a) // step) for a, z in zip(ends, ends[1:])]
    buckets = max(1, -(-max(found.values(), default=1) // BUCKET_ROWS))
    some = some.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = some.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("size", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = some.withColumn("rn", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "piece"))).join(before, ["size", "bucket"]).select("doc_id", "piece", "size", (F.col("before") + F.col("rn") - 1).alias("rank"))
    # The plan depends on the capacity, not on the number of documents: a row for each size of each pattern.
    rows = made.rows.sort_values(["size", "first"])
    shared = spark.sparkContext.broadcast((rows["size"].to_numpy() * (1 << 44) + rows["first"].to_numpy(), rows.to_numpy(), made, np.array(ends), np.array(steps)))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, plan_, made, ends, steps = shared.value
        before = np.cumsum(steps) - steps
        for f in frames:
            size, rank = f["size"].to_numpy(np.int64), f["rank"].to_numpy(np.int64)
            tier, _, first, _, base, each, offset = plan_[np.searchsorted(key, size * (1 << 44) + rank, "right") - 1].T
            j = rank - first
            c, start = made.windows(tier, base + j // each)
            part = np.searchsorted(ends, c, "right") - 1
            n = np.maximum(steps[part], 1)
            lap, at = (c - ends[part]) // n, (c - ends[part]) % n
            group = before[part] + np.where(lap % 2 == 0, at, n - 1 - at)
            yield pd.DataFrame({"doc_id": f["doc_id"], "piece": f["piece"], "container_id": c, "position": start + offset + j % each * size, "n_tokens": size, "tier": np.array(made.widths)[tier], "step_group": group})

    kind = sizes.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInPandas(place, f"doc_id {kind},piece int,container_id bigint,position bigint,n_tokens bigint,tier bigint,step_group bigint")
    empty = pieces.filter("size <= 0").select("doc_id", "piece", *[F.lit(v).cast("bigint").alias(c) for c, v in (("container_id", 0), ("position", 0), ("n_tokens", 0), ("tier", made.widths[-1]), ("step_group", 0))])
    return placed.unionByName(empty)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(cut(tokens.counted(table(spark, sf_dir, "documents"))))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per step group: containers, tokens, share of the room that is filled, and the attention cost (sum of squared sizes) that was balanced."""
    p = _packed(spark, sf_dir).groupBy("container_id", "step_group").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("cost"))
    return p.groupBy("step_group").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("n_tokens") / (F.count(F.lit(1)) * CAPACITY), 6).alias("filled"), F.sum("cost").alias("cost"))


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill}
