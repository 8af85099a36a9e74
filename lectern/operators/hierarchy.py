"""Problem 4: parent pointers to paths, depths, roots and descendants, with cycles named.

Pointer doubling: every open node takes over its pointer's own pointer and path, so the distance doubles with each
round and a tree of depth d is done after log2(d) rounds. A round carries open nodes only: what it closes is stored once and read again just for the
nodes that a pointer of the next round names. Nodes that a round leaves open when it closes none lead into a cycle. Among
those, doubling goes on without paths until the set of pointers no longer shrinks; it is then exactly the cycles.

Defined cases: a row without id is left out; of rows with one id the smallest by value counts; a null name is empty; a parent
that is not in the table gives `lost_parent`; a node that is its own parent is a cycle. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, table
from ..skew import skew_join

SEPARATOR = " / "


def _double(open_: DataFrame, state: DataFrame) -> DataFrame:
    """One round for the open nodes. Where the pointer names no node, the row is lost."""
    b = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("b_ptr"), F.col("lost").alias("b_lost"), F.col("ids").alias("b_ids"), F.col("names").alias("b_names"))
    j = skew_join(open_, b, ["ptr"], "left")
    known = F.col("b_ids").isNotNull()
    return j.select("id", F.when(known, F.col("b_ptr")).otherwise(F.col("ptr")).alias("ptr"), F.when(known, F.col("b_lost")).otherwise(True).alias("lost"), F.concat(F.coalesce("b_ids", F.array().cast("array<bigint>")), "ids").alias("ids"), F.concat(F.coalesce("b_names", F.array().cast("array<string>")), "names").alias("names"))


def hierarchy(nodes: DataFrame, id_col: str, parent_col: str, name_col: str) -> DataFrame:
    """(id, status, ids, names): status rooted, lost_parent, cycle or below_cycle; ids and names lead from the root to the node (rooted only)."""
    r = F.min(F.struct(F.col(parent_col).cast("bigint").alias("parent"), F.coalesce(F.col(name_col).cast("string"), F.lit("")).alias("name")))
    state = nodes.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(r.alias("r"))
    state = cut(state.select("id", F.col("r.parent").alias("ptr"), F.lit(False).alias("lost"), F.array("id").alias("ids"), F.array("r.name").alias("names")))
    is_open = F.col("ptr").isNotNull() & ~F.col("lost")
    closed, open_ = [state.filter(~is_open)], state.filter(is_open)
    left = open_.count()
    while left:
        wanted = open_.select(F.col("ptr").alias("id")).distinct()
        named = reduce(DataFrame.unionByName, [*closed, open_]).join(wanted, "id", "left_semi")
        state = cut(_double(open_, named))
        closed, open_ = [*closed, state.filter(~is_open)], state.filter(is_open)
        before, left = left, open_.count()
        if left == before:
            break
    empty = F.array()
    shut = reduce(DataFrame.unionByName, closed)
    done = shut.select("id", F.when(F.col("lost"), "lost_parent").otherwise("rooted").alias("status"), F.when(F.col("lost"), empty.cast("array<bigint>")).otherwise(F.col("ids")).alias("ids"), F.when(F.col("lost"), empty.cast("array<string>")).otherwise(F.col("names")).alias("names"))
    if not left:
        return done
    jump = open_.select("id", "ptr")
    images, before = jump.select("ptr").distinct().count(), -1
    while images != before:
        b = jump.select(F.col("id").alias("ptr"), F.col("ptr").alias("b_ptr"))
        jump = cut(skew_join(jump, b, ["ptr"], "inner").select("id", F.col("b_ptr").alias("ptr")))
        before, images = images, jump.select("ptr").distinct().count()
    on_cycle = jump.select(F.col("ptr").alias("id")).distinct().withColumn("status", F.lit("cycle"))
    rest = jump.select("id").join(on_cycle, "id", "left").select("id", F.coalesce("status", F.lit("below_cycle")).alias("status"), empty.cast("array<bigint>").alias("ids"), empty.cast("array<string>").alias("names"))
    return done.unionByName(rest)


def _collections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "zotero_collections")
    return c, cut(hierarchy(c, "collection_id", "parent_id", "name"))


def descendants(h: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id) of rooted nodes, each its own descendant. Comes from the paths, without a join."""
    return h.filter("status = 'rooted'").select(F.explode("ids").alias("ancestor_id"), F.col("id").alias("descendant_id"))


def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _collections(spark, sf_dir)[1]
    rooted = F.col("status") == "rooted"
    return h.select(F.col("id").alias("collection_id"), "status", F.when(rooted, F.array_join("names", SEPARATOR)).alias("path"), F.when(rooted, F.size("ids") - 1).alias("depth"), F.when(rooted, F.element_at("ids", 1)).alias("root_id"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(_collections(spark, sf_dir)[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, h = _collections(spark, sf_dir)
    finding = lambda df, name: df.select(F.col("id").alias("collection_id"), F.lit(name).alias("finding"))
    rooted = h.filter("status = 'rooted'")
    stored = c.filter("collection_id IS NOT NULL").groupBy(F.col("collection_id").cast("bigint").alias("id")).agg(F.min(F.struct(F.col("parent_id"), F.col("name"), F.col("path"), F.col("depth"))).alias("r")).select("id", F.col("r.path").alias("path"), F.col("r.depth").alias("depth"))
    both = rooted.select("id", F.array_join("names", SEPARATOR).alias("p"), (F.size("ids") - 1).alias("d")).join(stored, "id")
    pairs = descendants(h).withColumn("has", F.lit(1)).unionByName(table(spark, sf_dir, "collection_descendants").select(F.col("ancestor_id").cast("bigint").alias("ancestor_id"), F.col("descendant_id").cast("bigint").alias("descendant_id"), F.lit(2).alias("has")))
    wrong = pairs.groupBy("ancestor_id", "descendant_id").agg(F.bit_or("has").alias("has")).filter("has <> 3").select(F.col("ancestor_id").alias("id")).distinct().join(rooted.select("id"), "id", "left_semi")
    return (
        h.filter("status <> 'rooted'").select(F.col("id").alias("collection_id"), F.col("status").alias("finding"))
        .unionByName(finding(both.filter("NOT (path <=> p)"), "path"))
        .unionByName(finding(both.filter("NOT (depth <=> d)"), "depth"))
        .unionByName(finding(wrong, "descendants"))
    )


_TREE = """
WITH RECURSIVE c AS (SELECT DISTINCT collection_id AS id, name, parent_id AS parent, path, depth FROM zotero_collections),
tree AS (
  SELECT id, name AS p, 0 AS d, [id] AS ids FROM c WHERE parent IS NULL
  UNION ALL SELECT c.id, tree.p || ' / ' || c.name, tree.d + 1, list_append(tree.ids, c.id) FROM c JOIN tree ON c.parent = tree.id),
lost AS (
  SELECT id FROM c WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM c)
  UNION ALL SELECT c.id FROM c JOIN lost ON c.parent = lost.id),
stuck AS (SELECT id, parent FROM c WHERE id NOT IN (SELECT id FROM tree) AND id NOT IN (SELECT id FROM lost)),
walk AS (SELECT id, parent AS up FROM stuck UNION SELECT walk.id, stuck.parent FROM walk JOIN stuck ON walk.up = stuck.id),
cyclic AS (SELECT DISTINCT id FROM walk WHERE id = up),
status AS (
  SELECT id, 'rooted' AS status FROM tree UNION ALL SELECT id, 'lost_parent' FROM lost
  UNION ALL SELECT id, CASE WHEN id IN (SELECT id FROM cyclic) THEN 'cycle' ELSE 'below_cycle' END FROM stuck),
closure AS (SELECT unnest(ids) AS ancestor_id, id AS descendant_id FROM tree)
"""
QUERIES = {"p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants}
SQL = {
    "p4_hierarchy": _TREE + "SELECT status.id AS collection_id, status, p AS path, d AS depth, ids[1] AS root_id FROM status LEFT JOIN tree USING (id)",
    "p4_descendants": _TREE + "SELECT ancestor_id, descendant_id FROM closure",
    "p4_found": _TREE + """SELECT id AS collection_id, status AS finding FROM status WHERE status <> 'rooted'
UNION ALL SELECT c.id, 'path' FROM c JOIN tree USING (id) WHERE c.path IS DISTINCT FROM tree.p
UNION ALL SELECT c.id, 'depth' FROM c JOIN tree USING (id) WHERE c.depth IS DISTINCT FROM tree.d
UNION ALL SELECT id, 'descendants' FROM tree WHERE id IN (
  SELECT ancestor_id FROM ((SELECT ancestor_id, descendant_id FROM closure EXCEPT SELECT ancestor_id, descendant_id FROM collection_descendants)
  UNION ALL (SELECT ancestor_id, descendant_id FROM collection_descendants EXCEPT SELECT ancestor_id, descendant_id FROM closure)))""",
}
