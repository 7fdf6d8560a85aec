"""Anchor reconcile: align a base text with its variants and merge their changes.

A gap is a region between two anchors. An anchor is a token found exactly once on every
side of a gap, and on no side out of order with another such token. Gaps are refined level
by level (lines, then tokens, then characters), each level looking only inside the gaps the
level before left over, so repeated words become unique again.

All sides of a document are one row, so documents are dealt by key once and each is aligned where
it lies (`functions/anchors.py`): no token becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from palimpsest.functions.anchors import anchors, gaps
from palimpsest.functions.text import block_piece, blocks, hunk_category

LEVELS = ("line", "token", "char")
#: The characters on both sides of a hunk.
AROUND = ("base_left", "base_right", "variant_left", "variant_right")
#: Rows and characters of one batch that a task gives back.
BATCH_ROWS = 4096
BATCH_CHARS = 4_000_000
LONG, STRING = (LongType(), pa.int64()), (StringType(), pa.string())


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys into the configured number of shuffle partitions.

    The rows here are small on disk but cost much work, so the adaptive coalescing, which looks
    only at shuffle bytes, must not merge them into few tasks.
    """
    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(partitions, *keys)


def unequal_documents(
    texts: DataFrame, sides: Sequence[str], key: str, *, also: Sequence[str] = ()
) -> DataFrame:
    """Documents to align, dealt by key; those with a missing side or with equal sides drop out."""
    same = F.lit(True)
    for side in sides[1:]:
        same = same & (F.col(sides[0]) == F.col(side))
    return spread(texts.where(~same).select(F.col(key).alias("doc_id"), *sides, *also), "doc_id")


def _array(values: Sequence, kind: pa.DataType) -> pa.Array:
    """An Arrow column; lists of structs (tuples here) are built field by field, many times as fast."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    fields = list(kind.value_type)
    columns = list(zip(*chain.from_iterable(values))) or [()] * len(fields)
    items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, values), initial=0), pa.int32()), items)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([_array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows whose last element counts their characters, in batches of a bounded size."""
    waiting, size = [], 0
    for *row, characters in rows:
        waiting.append(row)
        size += characters
        if len(waiting) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield _batch(waiting, schema)
            waiting, size = [], 0
    if waiting:
        yield _batch(waiting, schema)


def mapped_documents(rows: DataFrame, build, fields: Sequence[tuple[str, tuple]]) -> DataFrame:
    """`build(key, texts)` of every document of `rows` (doc_id and its sides) as rows `doc_id, fields`."""
    target = StructType([rows.schema["doc_id"], *[StructField(n, t[0]) for n, t in fields]])
    values = [pa.field(n, t[1]) for n, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = ([column[i].as_py() for column in batch.columns] for i in range(batch.num_rows))
            found = (row for key, *texts in cells for row in build(key, texts))
            yield from _batched(found, pa.schema([batch.schema.field(0), *values]))

    return rows.mapInArrow(run, target)


def stable_anchors(
    texts: DataFrame, sides: Sequence[str], level: str, *, key: str = "doc_id"
) -> DataFrame:
    """Anchors of every document whose sides differ: `doc_id, token, {side}_pos`."""

    def build(doc_id, parts):
        return ((doc_id, *anchor, len(anchor[0])) for anchor in anchors(parts, level))

    fields = [("token", STRING), *[(f"{s}_pos", LONG) for s in sides]]
    return mapped_documents(unequal_documents(texts, sides, key), build, fields)


def aligned_gaps(
    texts: DataFrame,
    sides: Sequence[str],
    *,
    key: str = "doc_id",
    levels: Sequence[str] = LEVELS,
    around: bool = False,
) -> DataFrame:
    """Regions where the sides differ: `doc_id, {side}_start, {side}_end, {side}_text`.

    With `around` also the characters next to each, `{side}_left` and `{side}_right` (NULL at an end).
    """
    levels = tuple(levels)

    def build(doc_id, whole):
        for gap in gaps(whole, levels):
            row, size = [doc_id], 0
            for (start, part), text in zip(gap, whole):
                end = start + len(part)
                row += (start, end, part)
                size += len(part)
                if around:
                    row += (text[start - 1] if start else None, text[end] if end < len(text) else None)
            yield (*row, size)

    kinds = [("start", LONG), ("end", LONG), ("text", STRING)]
    if around:
        kinds += [("left", STRING), ("right", STRING)]
    return mapped_documents(unequal_documents(texts, sides, key), build, [(f"{s}_{n}", t) for s in sides for n, t in kinds])


def diff_hunks(
    texts: DataFrame, variant: str, *, base: str = "base", levels: Sequence[str] = LEVELS,
    around: bool = False,
) -> DataFrame:
    """Lossless change list between a base and one variant; `around` keeps the characters beside."""
    found = aligned_gaps(
        texts.select("doc_id", F.col(base).alias("base"), F.col(variant).alias("variant")),
        ("base", "variant"),
        levels=levels,
        around=around,
    )
    return found.select(
        "doc_id",
        F.col("base_start").alias("start"),
        F.col("base_end").alias("end"),
        "variant_start",
        "variant_end",
        F.col("base_text").alias("original"),
        F.col("variant_text").alias("replacement"),
        *(AROUND if around else ()),
    )


def boundary_map(
    positions: DataFrame,
    hunks: DataFrame,
    *,
    keys: Sequence[str] = ("doc_id",),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Map base positions (`keys, position, carry`) to variant coordinates.

    `mapped` is NULL strictly inside a replacement; `mapped_after_insert` falls behind an
    insertion made exactly at the position. `left_edge`/`right_edge` are the nearest mappable
    positions outwards, with their images. One window per document, no range join.
    """
    blank = F.lit(None).cast("struct<start:bigint,end:bigint,vs:bigint,ve:bigint>")
    asked = positions.select(
        *keys, F.col("position").cast("long").alias("at"), F.lit(1).alias("rank"),
        blank.alias("hunk"), *carry,
    )
    types = dict(positions.dtypes)
    known = hunks.select(
        *keys,
        F.col("start").cast("long").alias("at"),
        F.when(F.col("start") == F.col("end"), 0).otherwise(2).alias("rank"),
        F.struct(
            F.col("start").cast("long").alias("start"),
            F.col("end").cast("long").alias("end"),
            F.col("variant_start").cast("long").alias("vs"),
            F.col("variant_end").cast("long").alias("ve"),
        ).alias("hunk"),
        *[F.lit(None).cast(types[c]).alias(c) for c in carry],
    )
    order = (
        Window.partitionBy(*keys)
        .orderBy("at", "rank")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = (
        asked.unionByName(known)
        .withColumn("h", F.last("hunk", ignorenulls=True).over(order))
        .where(F.col("rank") == 1)
    )
    p, h = F.col("at"), F.col("h")
    inside = F.coalesce(h["end"] > p, F.lit(False)) & (h["start"] < p)
    after = F.when(h.isNull(), p).otherwise(p + h["ve"] - h["end"])
    before = F.when(h["start"] == p, h["vs"]).otherwise(after)
    return seen.select(
        *keys,
        p.alias("position"),
        *carry,
        F.when(~inside, before).alias("mapped"),
        F.when(~inside, after).alias("mapped_after_insert"),
        F.when(inside, h["start"]).otherwise(p).alias("left_edge"),
        F.when(inside, h["vs"]).otherwise(before).alias("left_image"),
        F.when(inside, h["end"]).otherwise(p).alias("right_edge"),
        F.when(inside, h["ve"]).otherwise(after).alias("right_image"),
    )


def classified_hunks(texts: DataFrame, hunks: DataFrame, variant: str) -> DataFrame:
    """Add `category` to hunks, looking at the characters on both sides of each change."""

    def around(text: Column, start: str, end: str) -> tuple[Column, Column]:
        left = F.when(F.col(start) > 0, F.substring(text, F.col(start).cast("int"), F.lit(1)))
        right = F.when(
            F.col(end) < F.length(text),
            F.substring(text, (F.col(end) + 1).cast("int"), F.lit(1)),
        )
        return left, right

    cut = spread(texts.select("doc_id", "base", F.col(variant).alias("_variant")), "doc_id")
    joined = spread(hunks, "doc_id").join(cut, "doc_id")
    beside = (*around(F.col("base"), "start", "end"), *around(F.col("_variant"), "variant_start", "variant_end"))
    return categorized(joined.withColumns(dict(zip(AROUND, beside)))).drop("base", "_variant")


def categorized(hunks: DataFrame) -> DataFrame:
    """Add `category` to hunks that carry the characters beside them."""
    base_left, base_right, variant_left, variant_right = [F.col(c) for c in AROUND]
    return hunks.withColumn(
        "category",
        hunk_category(
            F.col("original"), base_left, base_right,
            F.col("replacement"), variant_left, variant_right,
        ),
    ).drop(*AROUND)


def merge_components(texts: DataFrame, *, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Components of two corrections `a` and `b` against `base`, with their merge state.

    agreement: both made the same change; singleton: only one changed the base; conflict:
    both changed it differently, so the base text stays in the preview.
    """
    found = aligned_gaps(
        texts.select("doc_id", "base", "a", "b"), ("base", "a", "b"), levels=levels
    )
    return merge_states(
        found.withColumnsRenamed({"base_start": "start", "base_end": "end", "base_text": "original"})
    )


def merge_states(found: DataFrame) -> DataFrame:
    """The state and merged text of aligned components, whatever other columns they have."""
    base, a, b = F.col("original"), F.col("a_text"), F.col("b_text")
    return found.select(
        "doc_id", "start", "end", "original",
        "a_start", "a_end", "a_text",
        "b_start", "b_end", "b_text",
        F.when(a == b, "agreement")
        .when((a == base) | (b == base), "singleton")
        .otherwise("conflict")
        .alias("state"),
        F.when((a == b) | (b == base), a).when(a == base, b).otherwise(base).alias("merged"),
    )


def _cut_bases(texts: DataFrame) -> DataFrame:
    # below the join, so that the optimizer cannot repeat the cutting for every edit
    return spread(texts.select("doc_id", "base"), "doc_id").withColumn(
        "blocks", blocks(F.col("base"))
    )


def _rebuilt() -> Column:
    """The base text of a row, also given as `blocks`, with its sorted `edits` applied."""

    def part(edit: Column, index: Column) -> Column:
        begin = F.when(index > 0, F.get("edits", index - 1)["end"]).otherwise(F.lit(0))
        return F.concat(block_piece(F.col("blocks"), begin, edit["start"]), edit["replacement"])

    applied = F.concat(
        F.array_join(F.transform("edits", part), ""),
        block_piece(F.col("blocks"), F.element_at("edits", -1)["end"], F.length("base")),
    )
    return F.when(F.col("edits").isNull(), F.col("base")).otherwise(applied)


def apply_edits(texts: DataFrame, edits: DataFrame, output: str = "preview") -> DataFrame:
    """Rebuild each document from its base and sorted, non-overlapping edits.

    The edits of one document are bounded by the document itself, which already is one cell.
    """
    lists = (
        spread(edits.select("doc_id", "start", "end", "replacement"), "doc_id")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("edits"))
    )
    joined = _cut_bases(texts).join(lists, "doc_id", "left")
    return joined.select("doc_id", _rebuilt().alias(output))


# The counts of component states, in the order of their columns.
STATE_COUNTS = ("conflicts", "singletons", "agreements")


def _merged(base: str, a: str, b: str, levels: Sequence[str]) -> tuple:
    """Preview text and component counts of one document, in the terms of `merge_components`."""
    pieces, done, counts = [], 0, [0, 0, 0]
    for (start, old), (_, one), (_, two) in gaps((base, a, b), levels):
        state = 2 if one == two else 1 if old in (one, two) else 0
        counts[state] += 1
        pieces += (base[done:start], one if state == 2 or (state == 1 and two == old) else two if state == 1 else old)
        done = start + len(old)
    return "".join([*pieces, base[done:]]), *counts


def reconcile(texts: DataFrame, *, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Three-way merge of every document: preview text and component counts.

    Every row is aligned and rebuilt where it lies, so rows that share a `doc_id` are merged each on its own.
    A document with a missing side keeps its base.
    """
    levels = tuple(levels)
    equal = (F.col("base") == F.col("a")) & (F.col("base") == F.col("b"))
    sides = [F.when(~equal, F.col(side)).alias(side) for side in ("a", "b")]
    # by row, not by id: copies of one document do not meet in a task
    dealt = spread(texts.select("doc_id", "base", *sides), "doc_id", "base")

    def build(doc_id, whole):
        base, a, b = whole
        row = (base, 0, 0, 0) if base is None or a is None or b is None else _merged(base, a, b, levels)
        yield (doc_id, *row, len(row[0] or ""))

    return mapped_documents(dealt, build, [("preview", STRING), *[(name, LONG) for name in STATE_COUNTS]])
