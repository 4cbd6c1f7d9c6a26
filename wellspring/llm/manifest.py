"""Merkle manifest of a dataset by a nested-struct rollup.

Every row is a leaf: the hash of its fields. Within a group leaves ascend by id; every
``FAN`` consecutive nodes have their hash as parent until one is left, the group's subroot;
subroots, in the order of their groups, are the leaves of a last tree, whose root stands for
the whole table.

1. Leaves are hashed where the rows lie and written without their fields. A range exchange of
   the narrow leaves numbers them: a group, however large, lies in many ranges, and only the
   counts of (group, range) are added up.
2. ``DIGITS`` digits of a node's number in base ``FAN`` name its place in a block of
   ``FAN ** DIGITS`` nodes. One exchange places blocks; then the digits are grouped away from
   the last to the first, and each grouping hashes its children and nests their structs. What
   is left is one row for each block, bounded in size, with the whole subtree in it.
3. Block roots are the nodes of the next round, until each group has one; then the subroots
   are rolled up alike.
4. Downwards, a transform over the nested structs gives each child its siblings level by level
   and an explode emits it. The path above a block meets the block by a grouping of both by
   its key; nothing is joined.

Defined cases: a null field is hashed as "-", anything else as byte count, ":" and value, so
null and empty differ; a null group is a group and comes first; null ids come first in their
group; rows that share an id are leaves each, ordered by their hashes; a lone leaf is its own
subroot and a lone subroot the root; an empty table gives an empty manifest; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import by_place, position, written

#: Nodes that share a parent.
FAN = 3
#: Digits of a node's number that one block spans: 729 nodes.
DIGITS = 6
_INDEX_BITS = 33  # of monotonically_increasing_id


def field_text(value: Column) -> Column:
    """A field as it is hashed: "-" if null, else UTF-8 byte count, ":" and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with their number in the group (from 0, by ``order``) and the group's size, written.

    ``order`` ends in a column that tells equal rows apart, so that a range can cut them.
    """
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = written(spread.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", _INDEX_BITS)
    placed = placed.withColumn("part", part)
    counts = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        group, "part", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("here").over(whole).alias("nodes"),
    )
    numbered = placed.join(starts, [group, "part"]).withColumn("number", F.col("at") + F.col("shift"))
    return numbered.drop("at", "part", "shift")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """One row for each block of ``nodes`` (tree, number, nodes, node): tree, number, nodes, node.

    ``node`` is a struct with ``hash``; the block's has ``hash`` and the nested ``children``.
    ``nodes`` counts the tree's nodes before and after. A level that a tree no longer has, as
    one node is left, passes its only child's hash on.
    """
    digits = [F.expr(f"int(number div {FAN**k} % {FAN})").alias(f"d{k}") for k in range(DIGITS)]
    block = F.expr(f"number div {FAN**DIGITS}").alias("block")
    level = nodes.select("tree", "nodes", block, *digits, "node").repartition("tree", "block")
    for k in range(DIGITS):
        keys = ["tree", "nodes", "block", *(f"d{j}" for j in range(DIGITS - 1, k, -1))]
        grouped = level.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(f"d{k}", "node"))).alias("kids"))
        children = F.col("kids.node")
        joined = F.when(F.col("nodes") > FAN**k, F.sha2(F.concat_ws("", children["hash"]), 256))
        node = F.struct(joined.otherwise(children["hash"][0]).alias("hash"), children.alias("children"))
        level = grouped.select(*keys, node.alias("node"))
    left = F.ceil(F.col("nodes") / F.lit(FAN**DIGITS)).cast("long").alias("nodes")
    return level.select("tree", F.col("block").alias("number"), left, F.col("nodes").alias("below"), "node")


_STEPS = "array<struct<left:string,right:string>>"


def _unnested(node: Column, level: int, below: Column, path: Column, carried: dict[str, Column]) -> Column:
    """Nodes ``level`` levels below ``node`` as one array, each with its siblings up to the root."""
    if level == 0:
        return F.array(F.struct(node.alias("node"), path.alias("path"), *(c.alias(n) for n, c in carried.items())))
    children = node["children"]
    hashes = children["hash"]

    def child(kid: Column, i: Column) -> Column:
        left = F.concat_ws("", F.slice(hashes, F.lit(1), i))
        right = F.concat_ws("", F.slice(hashes, i + 2, F.lit(FAN)))
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        longer = F.when(below > FAN ** (level - 1), F.concat(step, path)).otherwise(path)
        return _unnested(kid, level - 1, below, longer, carried)

    return F.flatten(F.transform(children, child))


def unrolled(blocks: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The nodes that ``rolled_up`` nested, each with its path and the ``carried`` columns."""
    values = {n: F.col(n) for n in carried}
    rows = _unnested(F.col("node"), DIGITS, F.col("below"), F.col("path"), values)
    return blocks.select("tree", F.explode(rows).alias("row")).select("tree", "row.*")


def _rounds(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Tables of blocks, round by round, until every tree has one; ``most``: of nodes in a tree."""
    tables = [written(rolled_up(nodes))]
    while (most := -(-most // FAN**DIGITS)) > 1:
        node = F.struct(F.col("node.hash").alias("hash"), F.col("number"))
        tables.append(written(rolled_up(tables[-1].select("tree", "number", "nodes", node.alias("node")))))
    return tables


def _descended(tables: list[DataFrame], paths: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Nodes of the first round with their paths; ``paths`` has tree, path and ``carried``."""
    paths = paths.withColumn("number", F.lit(0).cast("long"))
    for table in reversed(tables):
        both = table.select("tree", "number", "below", "node").unionByName(paths, allowMissingColumns=True)
        known = [F.first(c, ignorenulls=True).alias(c) for c in ("below", "node", "path", *carried)]
        nodes = unrolled(both.groupBy("tree", "number").agg(*known), carried)
        if table is not tables[0]:
            paths = nodes.select("tree", F.col("node.number").alias("number"), "path", *carried)
    return nodes


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "source",
    found: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Of every row: its id, leaf, subroot, root, proof path, and the leaf that was found.

    ``path`` lists the siblings left and right of the node, level by level from the leaf to
    the root. ``found`` gives fields another value (expressions over the ``fields``, named
    f0, f1, … by place) under which the row is to be verified; without it, the row's own.
    """
    plain = by_place(docs)
    at = {n: F.col(f"c{position(docs, n)}") for n in (*fields, id_col, group_col)}
    rows = plain.select(
        *(at[n].alias(f"f{i}") for i, n in enumerate(fields)), at[id_col].alias("id"),
        F.coalesce(F.concat(F.lit("."), at[group_col].cast("string")), F.lit("")).alias("tree"),  # null first
    )
    own = [F.col(f"f{i}") for i in range(len(fields))]
    seen = [(found or {}).get(n, c) for n, c in zip(fields, own)]
    leaf, other = digest(*map(field_text, own)), digest(*map(field_text, seen))
    leaves = written(
        rows.select("tree", "id", leaf.alias("leaf"), other.alias("found"), F.monotonically_increasing_id().alias("turn"))
    )
    numbered = ranked(leaves, "tree", "id", "leaf", "found", "turn")
    node = F.struct(F.col("leaf").alias("hash"), "id", "found")
    nodes = numbered.select("tree", "number", "nodes", node.alias("node"))
    most = leaves.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    tables = _rounds(nodes, most)

    subroots = tables[-1].select(F.lit("").alias("all"), "tree", F.col("node.hash").alias("subroot"))
    in_order = ranked(subroots, "all", "tree")
    of_trees = F.struct(F.col("subroot").alias("hash"), "tree").alias("node")
    upper = _rounds(in_order.select(F.col("all").alias("tree"), "number", "nodes", of_trees), max(1, in_order.count()))
    top = upper[-1].select("tree", F.array().cast(_STEPS).alias("path"), F.col("node.hash").alias("root"))
    above = _descended(upper, top, ["root"])
    above = above.select(F.col("node.tree").alias("tree"), "path", "root", F.col("node.hash").alias("subroot"))

    out = _descended(tables, above, ["root", "subroot"])
    return out.select(
        F.col("node.id").alias("id"), F.col("node.hash").alias("leaf"), "subroot", "root", "path", F.col("node.found").alias("found")
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof_digest(path: Column) -> Column:
    """One hash over all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)
