"""Merkle manifest of a table, with a witness for every row.

Rows become leaves; the leaves of a group (a language) are appended in order of their ids to a tree in which every
run of `WIDTH` siblings has one parent. The roots of the groups are appended to one more tree in the same way.

Witnesses are built incrementally. Leaves are appended in aligned blocks of `WIDTH ** LEVELS`: a block is one task's
group, and nodes that wait for siblings are its open subtrees. When the last sibling of a run arrives, each node of the
run gets the digests on its left and right as its part of the witness; a leaf's witness is the chain of parts above it.
The root of a block is one node; roots of blocks are appends of the next round, in blocks of their own, until a group
has one node. On the way back every block's own witness extends those of the rows in it.

Defined results: a null field is `-` in a leaf, so null and empty differ; a null group is a group of its own and the
first; null ids come first in a group; rows with one id follow in order of their digests, so equal rows can change
places without changing any digest; very long texts are one field; extra columns take no part; an empty table gives an
empty manifest without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.materialize import materialize
from palimpsest.llm.ranks import places

#: Siblings of one parent.
WIDTH = 8
#: Levels of a block; a block has at most WIDTH ** LEVELS nodes.
LEVELS = 3

WITNESS = T.ArrayType(T.StructType().add("left", T.StringType()).add("right", T.StringType()))
_PART = pa.struct([("left", pa.string()), ("right", pa.string())])


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def folded(start: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, start, lambda at, part: digest(part["left"], at, part["right"]))


def siblings(witness: Column) -> Column:
    """All digests of a witness, level by level, left to right."""
    return F.concat_ws("", F.transform(witness, lambda part: F.concat(part["left"], part["right"])))


class Node:
    """A digest in an open or finished subtree; `left`, `right` and `parent` come with its run's last sibling."""

    __slots__ = ("digest", "left", "right", "parent")

    def __init__(self, value: str):
        self.digest, self.left, self.right, self.parent = value, "", "", None

    def witness(self) -> Iterator[tuple[str, str]]:
        node = self
        while node.parent is not None:
            yield node.left, node.right
            node = node.parent


class Appender:
    """A tree of `levels` levels that takes nodes one by one."""

    def __init__(self, levels: int, width: int = WIDTH):
        self.width, self.open, self.root = width, [[] for _ in range(levels)], None

    def append(self, value: str) -> Node:
        node = Node(value)
        self._place(node, 0)
        return node

    def close(self) -> Node:
        """Finish the runs that got no more siblings; returns the root."""
        for level, run in enumerate(self.open):
            if run:
                self._complete(level)
        return self.root

    def _place(self, node: Node, level: int) -> None:
        if level == len(self.open):
            self.root = node
            return
        self.open[level].append(node)
        if len(self.open[level]) == self.width:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [node.digest for node in run]
        parent = Node(hashlib.sha256("".join(digests).encode()).hexdigest())
        for i, node in enumerate(run):
            node.left, node.right, node.parent = "".join(digests[:i]), "".join(digests[i + 1 :]), parent
        self._place(parent, level + 1)


def _levels(nodes: int, most: int) -> int:
    """Levels that a block of a tree with so many nodes has: up to one node, at most `most`."""
    levels = 0
    while nodes > 1 and levels < most:
        nodes, levels = -(-nodes // WIDTH), levels + 1
    return levels


def _appended(rows: pa.Table, most: int) -> tuple[list[Node], Node]:
    """The nodes of one block in order of the rows, and its root."""
    places = rows["~place"].to_numpy()
    tree = Appender(_levels(rows["~nodes"][0].as_py(), most))
    values = rows["~digest"].to_pylist()
    nodes = [None] * len(values)
    for i in places.argsort(kind="stable").tolist():
        nodes[i] = tree.append(values[i])
    return nodes, tree.close()


def _block_root(most: int):
    def build(rows: pa.Table) -> pa.Table:
        _, root = _appended(rows, most)
        left = -(-rows["~nodes"][0].as_py() // WIDTH**most)
        return pa.table(
            {
                "~group": rows["~group"][:1],
                "~place": rows["~block"][:1],
                "~nodes": pa.array([left], pa.int64()),
                "~digest": pa.array([root.digest]),
            }
        )

    return build


def _extended(kept: Sequence[str], most: int):
    def extend(rows: pa.Table, above: pa.Table) -> pa.Table:
        nodes, _ = _appended(rows, most)
        outer = [(p["left"], p["right"]) for p in above["~witness"][0].as_py()]
        parts = [[*node.witness(), *outer] for node in nodes]
        ends = [0]
        for p in parts:
            ends.append(ends[-1] + len(p))
        flat = [x for p in parts for x in p]
        pairs = pa.StructArray.from_arrays([pa.array([x for x, _ in flat], pa.string()), pa.array([y for _, y in flat], pa.string())], fields=list(_PART))
        witness = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        out = rows.select(list(kept)).append_column("~witness", witness)
        return out.append_column("~subroot", pa.repeat(above["~subroot"][0], len(rows)))

    return extend


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of appends (the first is `nodes`), and one root per group: `~group, ~digest, ~round`.

    nodes: `~group, ~place, ~nodes, ~digest` and what the caller keeps. A group with one node left is finished.
    """
    size, rounds, roots, current = WIDTH**LEVELS, [], None, nodes
    while True:
        current = current.withColumn("~block", F.floor(F.col("~place") / size).cast("long"))
        rounds.append(current)
        made = materialize(
            current.select("~group", "~block", "~place", "~nodes", "~digest").groupBy("~group", "~block").applyInArrow(
                _block_root(LEVELS), "`~group` string, `~place` long, `~nodes` long, `~digest` string"
            )
        )
        done = made.where("`~nodes` = 1").select("~group", "~digest", F.lit(len(rounds) - 1).alias("~round"))
        roots = done if roots is None else roots.unionByName(done)
        current = made.where("`~nodes` > 1")
        if current.isEmpty():
            return rounds, roots


def _handed_down(rounds: list[DataFrame], above: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Rows of the first round with `~witness` and `~subroot`; above: `~group, ~round, ~witness, ~subroot` of the groups."""
    outer = None
    for k in range(len(rounds) - 1, -1, -1):
        ends = above.where(F.col("~round") == k).select("~group", F.lit(0).cast("long").alias("~block"), "~witness", "~subroot")
        outer = ends if outer is None else outer.withColumnRenamed("~place", "~block").unionByName(ends)
        columns = ["~group", "~place"] if k else list(kept)
        schema = rounds[k].select(*columns).schema.add("~witness", WITNESS).add("~subroot", "string")
        rows = rounds[k].select(*dict.fromkeys([*columns, "~group", "~place", "~nodes", "~digest", "~block"]))
        outer = rows.groupBy("~group", "~block").cogroup(outer.groupBy("~group", "~block")).applyInArrow(_extended(columns, LEVELS), schema)
    return outer


def grow(leaves: DataFrame, group: str, order: Sequence[str], value: str) -> tuple[list[DataFrame], DataFrame]:
    """Append every row's digest to the tree of its group; see `_rounds`. `group` must be a string and not null."""
    placed = places(leaves, group, order, "~place", "~nodes")
    return _rounds(placed.withColumns({"~group": F.col(group), "~digest": F.col(value)}))


def manifest(leaves: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """`leaves` with `subroot` (of the group's tree), `root` (of all) and `witness` (from the leaf to the root).

    `value` is a leaf's digest; leaves of a group are appended by `order`, nulls first, the groups' roots by `group`.
    """
    named = F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit(""))  # null before all names, bytewise order kept
    rounds, subroots = grow(leaves.withColumn("~of", named).withColumn("~salt", F.monotonically_increasing_id()), "~of", [*order, value, "~salt"], value)
    subroots = materialize(subroots.withColumnsRenamed({"~group": "~of", "~digest": "~subroot", "~round": "~depth"}).withColumn("~all", F.lit("")))
    tops, root = grow(subroots, "~all", ["~of"], "~subroot")
    root = root.select("~digest").first()
    no_witness = F.array().cast(WITNESS)
    if root is None:
        none = F.lit(None).cast("string")
        return leaves.limit(0).select("*", none.alias("subroot"), none.alias("root"), no_witness.alias("witness"))
    only = root_row(leaves, len(tops), no_witness)
    above = _handed_down(tops, only, ["~of", "~depth", "~digest"])
    above = materialize(above.select(F.col("~of").alias("~group"), F.col("~depth").alias("~round"), "~witness", F.col("~digest").alias("~subroot")))
    rows = _handed_down(rounds, above, leaves.columns)
    return rows.select(*leaves.columns, F.col("~subroot").alias("subroot"), F.lit(root[0]).alias("root"), F.col("~witness").alias("witness"))


def root_row(frame: DataFrame, rounds: int, no_witness: Column) -> DataFrame:
    """What stands above the one tree of all groups: nothing."""
    one = frame.sparkSession.range(1)
    return one.select(F.lit("").alias("~group"), F.lit(rounds - 1).alias("~round"), no_witness.alias("~witness"), F.lit(None).cast("string").alias("~subroot"))


def documents(docs: DataFrame) -> DataFrame:
    """Leaves of documents: `doc_id, lang, leaf, tampered`; `tampered` is the leaf after A-Z of the text were lower-cased.

    Only every third row by checksum of its id is tampered with, elsewhere (and where nothing changes) it equals `leaf`.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    names = ("doc_id", "source", "lang", "n_chars")
    own = leaf(*[F.col(c) for c in names], F.col("text"))
    other = leaf(*[F.col(c) for c in names], lower)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return materialize(docs.select("doc_id", "lang", own.alias("leaf"), F.when(hit, other).otherwise(own).alias("tampered")))


def audit(rows: DataFrame) -> DataFrame:
    """Digest columns of a manifest of `documents`: the witness, and the root that the tampered leaf leads to."""
    proved = rows.withColumn("folded_root", folded(F.col("tampered"), F.col("witness")))
    proof = F.sha2(siblings(F.col("witness")), 256).alias("proof_sha256")
    return proved.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
