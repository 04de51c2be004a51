"""Merkle manifest of a table by butterfly exchange.

The nodes of a tree (leaves in order, ``FANOUT`` to a parent) are cut into aligned partitions of a power of the fanout. Every
partition hashes its own subtree. Then, round by round, the partitions that hold the same place in the children of one
parent swap the roots they have so far, and each of them hashes the parent itself. After as many rounds as there are
levels above the partitions, every partition knows the tree's root and the siblings on its way up, so nothing has to be
passed down again. Many trees of any size go through the same rounds.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evispan.session import materialize_plain as materialize

FANOUT = 3
# Levels inside a partition: 3^7 = 2,187 leaves.
LOCAL_LEVELS = 7
# What stands left and right of a node among the children of one parent, digests joined; one entry per level.
PATH = "array<struct<before: string, after: string>>"


def digest_of(*columns: Column) -> Column:
    """Lowercase hex sha256 of the columns, each ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    fields = []
    for c in columns:
        value = c.cast("string")
        fields.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*fields), 256)


def fold(node: Column, path: Column) -> Column:
    """The root that follows from a node and its path."""
    return F.aggregate(path, node, lambda own, at: F.sha2(F.concat(at["before"], own, at["after"]), 256))


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda at: F.concat(at["before"], at["after"]))), 256)


def parents(nodes: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def subtree(nodes: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """Levels from the nodes up: ``levels`` of them above, or (None) as many as it takes to one node."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        out.append(parents(out[-1], fanout))
    return out


def local_paths(levels: list[list[str]], fanout: int) -> list[list[tuple[str, str]]]:
    """``(before, after)`` of each node of the lowest level, for every level below the top."""
    out: list[list[tuple[str, str]]] = [[] for _ in levels[0]]
    span = 1
    for nodes in levels[:-1]:
        around = []
        for i in range(len(nodes)):
            first = i - i % fanout
            around.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
        for i, path in enumerate(out):
            path.append(around[i // span])
        span *= fanout
    return out


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (with ``tree``) with ``index``, the place of every row in its tree, from 0, by ``order`` (nulls first), and
    ``total``, the rows of its tree; written.

    Rows are range-partitioned and sorted, so that a tree with many rows spreads over many tasks; places are the place in
    the range plus the counts of the tree's rows in the ranges before. Equal rows get any of their places.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "tie")]  # the last one parts a crowd of equal rows
    placed = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.drop("tie").withColumn("range", F.spark_partition_id()).withColumn("index", F.monotonically_increasing_id())
    placed = materialize(placed, "merkle-ranked")
    counts = placed.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("first"))
    tree = Window.partitionBy("tree")  # here one row per tree and range
    shift = counts.select(
        "tree", "range", (F.sum("n").over(tree.orderBy("range")) - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(tree).alias("total"),
    )
    return placed.join(shift, ["tree", "range"]).withColumn("index", F.col("index") + F.col("shift")).drop("shift", "range")


def exchange(parts: DataFrame, fanout: int, round_: int) -> DataFrame:
    """One round for ``tree, part, parts, node, path``: ``node`` rises from level ``round_`` above the partitions to the next.

    The partners of a partition are those with its place in the other children of its parent: their distance is a power of
    the fanout. The last child may have too few partitions; the ones it has then also speak for the missing places.
    """
    stride = fanout**round_
    lane, child = F.col("part") % stride, F.floor(F.col("part") / stride).cast("bigint")
    in_last = F.col("parts") - F.floor((F.col("parts") - 1) / stride) * stride
    spoken = F.when(
        (child == F.floor((F.col("parts") - 1) / stride)) & (in_last < stride),
        F.sequence(lane, F.lit(stride - 1).cast("bigint"), in_last.cast("bigint")),
    ).otherwise(F.array(lane))
    sent = parts.select(
        "tree", "parts", F.floor(child / fanout).alias("parent"), (child % fanout).alias("child"), lane.alias("own"),
        F.explode(spoken).alias("lane"), "node", "part", "path",
    )
    seat = F.struct(
        "child", "node", F.when(F.col("lane") == F.col("own"), F.col("part")).alias("part"),
        F.when(F.col("lane") == F.col("own"), F.col("path")).alias("path"),
    )
    met = sent.groupBy("tree", "parent", "lane", "parts").agg(F.collect_list(seat).alias("seats"))  # at most the fanout
    nodes = lambda keep: F.concat_ws("", F.transform(F.array_sort(F.filter("seats", keep), _by_child), lambda s: s["node"]))
    risen = met.withColumn("whole", F.sha2(nodes(lambda s: F.lit(True)), 256)).withColumn("seat", F.explode("seats"))
    own = F.col("seat")["child"]
    at = F.struct(nodes(lambda s: s["child"] < own).alias("before"), nodes(lambda s: s["child"] > own).alias("after"))
    return risen.where(F.col("seat")["part"].isNotNull()).select(
        "tree", F.col("seat")["part"].alias("part"), "parts", F.col("whole").alias("node"),
        F.concat(F.col("seat")["path"], F.array(at)).alias("path"),
    )


def _by_child(a: Column, b: Column) -> Column:
    return F.when(a["child"] < b["child"], -1).when(a["child"] > b["child"], 1).otherwise(0)


def rounds(parts: int, fanout: int) -> int:
    """Levels above that many partitions."""
    n = 0
    while parts > 1:
        parts, n = -(-parts // fanout), n + 1
    return n


STATE = "tree string, part bigint, parts bigint, node string"


def partitioned(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Ranked nodes with the aligned partition they belong to and the number of partitions of their tree."""
    size = fanout**levels
    part, parts = F.floor(F.col("index") / size), F.ceil(F.col("total") / size)
    return nodes.withColumn("part", part.cast("bigint")).withColumn("parts", parts.cast("bigint")).drop("total")


def climbed(cut: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``tree, part, parts, node, path``: of every partition the root of its tree, and the path from its own subtree's root."""
    schema = pa.schema([("tree", pa.string()), ("part", pa.int64()), ("parts", pa.int64()), ("node", pa.string())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        nodes = rows.sort_by("index")["node"].to_pylist()
        top = subtree(nodes, fanout, None if key[2].as_py() == 1 else levels)[-1][0]
        return pa.table([[k.as_py()] for k in key] + [[top]], schema=schema)

    own = cut.select("tree", "part", "parts", "index", "node").groupBy("tree", "part", "parts").applyInArrow(run, STATE)
    state = materialize(own.withColumn("path", F.array().cast(PATH)), "merkle-round")
    for n in range(rounds(state.agg(F.max("parts")).first()[0] or 0, fanout)):
        rising = F.col("parts") > fanout**n
        state = materialize(exchange(state.where(rising), fanout, n).unionByName(state.where(~rising)), "merkle-round")
    return state


def whole_paths(cut: DataFrame, state: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Every row of ``cut`` (``tree, row, ...``) with ``subroot``, ``root`` and the whole path from its node to the root.
    Partitions meet what they learned (``tree, part, node, root, path``); the way inside a partition is hashed again."""
    rows_type = dict(cut.dtypes)["row"]
    arrow_path = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        nodes = rows["node"].to_pylist()
        below = subtree(nodes, fanout, None if known["parts"][0].as_py() == 1 else levels)
        above = [(at["before"], at["after"]) for at in known["path"][0].as_py()]
        flat = [at for path in local_paths(below, fanout) for at in (*path, *above)]
        steps = pa.StructArray.from_arrays(
            [pa.array([b for b, _ in flat], pa.string()), pa.array([a for _, a in flat], pa.string())], ["before", "after"]
        )
        per_row = len(below) - 1 + len(above)
        paths = pa.ListArray.from_arrays(pa.array(range(0, per_row * len(nodes) + 1, per_row) if per_row else [0] * (len(nodes) + 1), pa.int32()), steps)
        constant = lambda name: pa.array([known[name][0].as_py()] * len(nodes), pa.string())
        return pa.table(
            [rows["tree"], rows["row"], constant("node"), constant("root"), paths.cast(arrow_path)],
            names=["tree", "row", "subroot", "root", "path"],
        )

    return (
        cut.groupBy("tree", "part")
        .cogroup(state.select("tree", "part", "parts", "node", "root", "path").groupBy("tree", "part"))
        .applyInArrow(run, f"tree string, row {rows_type}, subroot string, root string, path {PATH}")
    )


def merkle_proofs(
    nodes: DataFrame, tree_col: str, order: list[str], node_col: str, fanout: int = FANOUT, levels: int = LOCAL_LEVELS
) -> DataFrame:
    """Every row with ``subroot`` (root of its tree), ``root`` (of all trees) and ``path`` (from its node to the root).

    Rows of one value of ``tree_col`` are a tree, ordered by ``order`` (nulls first, then the node); its nodes are hex digests.
    Every ``fanout`` consecutive nodes, the last fewer, even one, become their digest while several remain; a lone node
    is its own root. Subroots in the order of their trees (null first, then by UTF-8 bytes) are the leaves of one more tree.
    ``fold(node, path)`` gives the root, ``siblings_digest(path)`` names the proof. A null tree is a tree; repeated rows are
    leaves of their own; columns called ``subroot``, ``root`` or ``path`` are replaced, all others are kept; an
    empty table gives an empty result.
    """
    payload = [c for c in nodes.columns if c.lower() not in ("subroot", "root", "path")]
    tree = F.when(F.col(f"`{tree_col}`").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(f"`{tree_col}`").cast("string")))
    inner = [f"by{i}" for i in range(len(order))]
    rows = nodes.select(
        tree.alias("tree"), *(F.col(f"`{c}`").alias(n) for c, n in zip(order, inner)), F.col(f"`{node_col}`").alias("node"),
        F.struct(*(F.col(f"`{c}`") for c in payload)).alias("row"),
    )
    cut = partitioned(ranked(rows, [*inner, "node"]).drop(*inner), fanout, levels)
    state = climbed(cut, fanout, levels)
    # The trees' roots are the leaves of the top tree; its partitions are climbed and met in the same way.
    top = state.where("part = 0").select(F.lit("").alias("tree"), F.col("tree").alias("by0"), "node", F.struct("tree").alias("row"))
    top_cut = partitioned(ranked(top, ["by0"]).drop("by0"), fanout, levels)
    top_state = climbed(top_cut, fanout, levels).withColumn("root", F.col("node"))
    upper = whole_paths(top_cut, top_state, fanout, levels).select(F.col("row.tree").alias("tree"), "root", F.col("path").alias("above"))
    known = state.join(upper, "tree").withColumn("path", F.concat("path", "above")).drop("above")
    return whole_paths(cut, known, fanout, levels).select(*(F.col(f"row.`{c}`") for c in payload), "subroot", "root", "path")


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree_col: str = "source",
    id_col: str = "doc_id",
    fanout: int = FANOUT,
    levels: int = LOCAL_LEVELS,
) -> DataFrame:
    """One row per input row: ``id, tree, leaf, subroot, root, path``; the leaf is the digest of ``columns``, null ones too.
    Other columns are ignored. See ``merkle_proofs`` for order, repeated rows and nulls."""
    leaf = digest_of(*(F.col(f"`{c}`") for c in columns))
    nodes = docs.select(F.col(f"`{id_col}`"), F.col(f"`{tree_col}`"), leaf.alias("leaf"))
    return merkle_proofs(nodes, tree_col, [id_col], "leaf", fanout, levels)
