"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source is cut into blocks of about equal size, by its words or its rows, whichever makes more: a document's block is a hash of its id, so block
   order is a random permutation of the source that every rerun and every executor agrees on.
2. A source's target (in words) becomes a quota of whole blocks: full passes, then the first blocks of
   one more pass. The block in which the target falls is filled document by document.
3. The quotas of all sources are split among output shards by a binary tree: the left child draws its
   number of blocks from the parent's blocks without replacement (a multivariate-hypergeometric draw), the
   right child keeps the rest. Quotas of the leaves add up exactly.
4. The shards draw disjoint runs of every source's permuted blocks, and each shard is shuffled on its own.

Block and source tables are plans, not data: at most `2 * BLOCKS_PER_SHARD * shards` blocks plus one per
source, and one row per source. They go through the driver; documents and their ids do not.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own, last;
repeated rows count and are taken on their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize
from palimpsest.llm.words import slices, texts_of, tidied, words_of

SHARDS = 64
BLOCKS_PER_SHARD = 16
#: Words of a block at least: the block that is filled document by document needs some to choose from.
LEAST_BLOCK = 65_536
#: Rows with words of a block at least, where texts are so short that rows and not words make the blocks.
LEAST_ROWS = 4_096
SEED = 20240917
#: Rows of the source table that may go through the driver.
MOST_SOURCES = 1_000_000


def sizes(docs: DataFrame) -> DataFrame:
    """`doc_id, source, size`: words of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts = words_of(texts_of(part.column("text"))).counts
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), pa.array(counts, pa.int64())], ["doc_id", "source", "size"]
                )

    chosen = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")
    )
    return chosen.mapInArrow(tidied(run), "doc_id long, source string, size long")


def targets(amounts: np.ndarray, weights: np.ndarray, share: float, cap: float) -> np.ndarray:
    """Shares of `share * sum(amounts)` by weight, none above `cap` times its amount; the excess is reshared."""
    amounts = amounts.astype(float)
    out, free = np.zeros(len(amounts)), np.ones(len(amounts), dtype=bool)
    left = min(share, cap) * amounts.sum()
    while free.any():
        wanted = left * weights / weights[free].sum()
        above = free & (wanted > cap * amounts)
        if not above.any():
            out[free] = wanted[free]
            break
        out[above] = cap * amounts[above]
        left -= out[above].sum()
        free &= ~above
    return out


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of every source for every shard (sources x shards); rows add up to the quotas exactly."""
    if shards == 1:
        return quotas.reshape(-1, 1)
    left = shards // 2
    total = int(quotas.sum())
    drawn = rng.multivariate_hypergeometric(quotas, total * left // shards, method="marginals") if total else quotas * 0
    return np.hstack([splitting_tree(drawn, left, rng), splitting_tree(quotas - drawn, shards - left, rng)])


@dataclass
class Mix:
    """The plan of a mix.

    `rows` has one row a document; `sources` one a source; `counts` one a block (copies, and words left to fill
    if it is open); `filled` the documents of open blocks that have words; `blocks` one row a drawn block and its shard.
    """

    rows: DataFrame
    sources: DataFrame
    counts: DataFrame
    filled: DataFrame
    blocks: DataFrame


def _with_block(frame: DataFrame, sources: DataFrame) -> DataFrame:
    named = frame.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    return named.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.col("n_blocks")).cast("int"))


def _nearest(size: np.ndarray, left: int) -> np.ndarray:
    """A subset whose sum comes near `left`: first fit in permuted order, and in a few more orders while that is not exact."""
    best, least = np.zeros(len(size), dtype=np.int32), left
    rng = np.random.default_rng(SEED)
    for attempt in range(64):
        order = range(len(size)) if attempt == 0 else np.argsort(-size) if attempt == 1 else rng.permutation(len(size))
        more, rest = np.zeros(len(size), dtype=np.int32), left
        for i in order:
            if 0 < size[i] <= rest:
                more[i], rest = 1, rest - size[i]
        spare = np.flatnonzero((more == 0) & (size > 0))
        if len(spare) and size[spare].min() - rest < rest:  # overshooting by the smallest comes nearer
            extra = spare[size[spare].argmin()]
            more[extra], rest = 1, size[extra] - rest
        if rest < least:
            best, least = more, rest
        if 1000 * least <= left:
            break
    return best


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """One more copy of documents of the open block, so that the source comes near its target."""
    group = group.sort_values(["turn", "doc_id"], kind="stable").reset_index(drop=True)
    more = _nearest(group["size"].to_numpy(), int(group["left"].iloc[0]))
    kept = ["doc_id", "source", "size", "source_size", "target", "copies", "sid", "block"]
    return group.assign(copies=(group["copies"] + more).astype("int32"))[kept]


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int = SHARDS) -> Mix:
    """How often every document is taken, and the shard of every block's every copy.

    Sources in code-point order (null last) have the weights in turn. `rows`: doc_id, source, size,
    source_size, target, copies, sid, block. `blocks`: sid, block, copy, shard.
    """
    spark = docs.sparkSession
    sized = materialize(sizes(docs))
    found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError("too many sources for a plan on the driver: group them first")
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    words = np.array([r["words"] for r in found], dtype=np.int64)
    wanted = targets(words, np.resize(np.array(weights, float), len(words)), share, cap) if len(found) else np.zeros(0)
    per_block = max(LEAST_BLOCK, int(words.sum()) // (shards * BLOCKS_PER_SHARD))
    counted = np.array([r["rows"] for r in found], dtype=np.int64)
    per_rows = max(LEAST_ROWS, int(counted.sum()) // (shards * BLOCKS_PER_SHARD))
    n_blocks = np.maximum(1, np.maximum(words // per_block, counted // per_rows))
    sources = spark.createDataFrame(
        [(r["source"], i, int(n_blocks[i]), int(words[i]), float(wanted[i])) for i, r in enumerate(found)],
        "name string, sid int, n_blocks int, source_size long, target double",
    )
    placed = _with_block(sized, sources)
    held: dict[int, dict[int, int]] = {}
    for r in placed.groupBy("sid", "block").agg(F.sum("size").alias("words")).collect():
        held.setdefault(r["sid"], {})[r["block"]] = r["words"]

    quotas, rows = np.zeros(len(found), np.int64), []
    for i in range(len(found)):
        amount = np.array([held[i].get(b, 0) for b in range(n_blocks[i])], np.int64)
        goal = round(wanted[i])
        passes = int(goal // words[i]) if words[i] else 0
        left = goal - passes * int(words[i])
        ends = np.cumsum(amount)
        whole = int(np.searchsorted(ends, left, "right")) if left else 0
        left -= int(ends[whole - 1]) if whole else 0
        quotas[i] = passes * n_blocks[i] + whole + (left > 0)
        rows += [(i, b, passes + (b < whole), left if b == whole else 0) for b in range(n_blocks[i])]
    taken = splitting_tree(quotas, shards, np.random.default_rng(SEED)) if len(found) else np.zeros((0, shards), int)
    drawn = []
    for i in range(len(found)):
        shard = np.repeat(np.arange(shards), taken[i])
        drawn += [(i, int(k % n_blocks[i]), int(k // n_blocks[i]) + 1, int(s)) for k, s in enumerate(shard)]

    blocks = spark.createDataFrame(rows, "sid int, block int, copies int, left long")
    placed = placed.join(F.broadcast(blocks), ["sid", "block"])
    # a row without words needs no filling: its copies are those of its block
    closed = placed.where("left = 0 or size = 0").select("doc_id", "source", "size", "source_size", "target", "copies", "sid", "block")
    opened = placed.where("left > 0 and size > 0").withColumn("turn", F.xxhash64(F.lit(SEED + 1), F.col("doc_id")))
    # an open group is one block of one source: about the rows and words of a block bound it
    filled = materialize(opened.groupBy("sid").applyInPandas(_fill, closed.schema))
    drawn = spark.createDataFrame(drawn, "sid int, block int, copy int, shard int")
    return Mix(closed.unionByName(filled), sources, blocks, filled, drawn)


def dealt(made: Mix) -> DataFrame:
    """The plan's rows with `shards`: the shard that every copy of a document is dealt to, in order of its copies."""
    drawn = F.array_sort(F.collect_list(F.struct("copy", "shard")))
    shards = made.blocks.groupBy("sid", "block").agg(drawn.alias("drawn"))
    own = F.filter("drawn", lambda x: x["copy"] <= F.col("copies"))["shard"]
    return made.rows.join(F.broadcast(shards), ["sid", "block"], "left").select(
        *made.rows.columns, F.coalesce(own, F.array().cast("array<int>")).alias("shards")
    )


def mix(docs: DataFrame, shards: int = SHARDS, **choices) -> DataFrame:
    """The mixed rows themselves: the columns of `docs`, once per copy, in `shards` locally shuffled partitions.

    A document's copies follow from its source and block, so texts meet only small plan tables; rows of the
    open blocks (one per source) are matched by id. The one shuffle of texts deals them to their shards.
    """
    made = plan(docs, shards=shards, **choices)
    own = lambda frame: frame.select(*(F.col(c).alias(f"~{c}") for c in frame.columns))  # noqa: E731  no clash with columns of docs
    key = F.col("doc_id").cast("long")
    named = docs.join(F.broadcast(own(made.sources)), F.col("source").cast("string").eqNullSafe(F.col("~name")))
    placed = named.withColumn("~of", F.pmod(F.xxhash64(F.lit(SEED), key), F.col("~n_blocks")).cast("int"))
    at_block = (F.col("~sid") == F.col("~s")) & (F.col("~of") == F.col("~b"))
    counts = own(made.counts).withColumnsRenamed({"~sid": "~s", "~block": "~b"})
    known = placed.join(F.broadcast(counts), at_block).drop("~s", "~b")
    # rows of one id, source and size may differ by one copy: the first ones (by text) have it
    alike = made.filled.groupBy("doc_id", "sid", "size")
    filled = own(alike.agg(F.min("copies").alias("least"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("more")))
    filled = filled.withColumnsRenamed({"~sid": "~s"})
    words = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    turn = Window.partitionBy(key, "~sid", "~words").orderBy(F.xxhash64(F.col("text").cast("string")))
    opened = known.where("`~left` > 0").withColumn("~words", words.cast("long")).withColumn("~turn", F.row_number().over(turn))
    same = key.eqNullSafe(F.col("~doc_id")) & (F.col("~sid") == F.col("~s")) & (F.col("~words") == F.col("~size"))
    opened = opened.join(filled, same, "left")
    copies = F.col("~least") + (F.col("~turn") <= F.col("~more")).cast("int")
    opened = opened.withColumn("~copies", F.coalesce(copies, "~copies"))  # rows without words are not in it
    opened = opened.drop("~doc_id", "~s", "~size", "~least", "~more", "~words", "~turn")
    known = known.where("`~left` = 0").unionByName(opened).where("`~copies` > 0")
    each = known.withColumn("~turn", F.explode(F.sequence(F.lit(1), F.col("~copies"))))
    drawn = own(made.blocks).withColumnsRenamed({"~sid": "~s", "~block": "~b"})
    dealt = each.join(F.broadcast(drawn), at_block & (F.col("~turn") == F.col("~copy")), "left")
    order = F.xxhash64(F.lit(SEED + 2), key, F.col("~turn"))
    return dealt.repartition(shards, "~shard").sortWithinPartitions("~shard", order).select(*(F.col(f"`{c}`") for c in docs.columns))
