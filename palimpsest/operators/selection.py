"""Conflict cases, their candidates and contexts, and packing into selection batches."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from palimpsest.functions.anchors import gaps
from palimpsest.functions.hashing import framed, text_id
from palimpsest.functions.materialize import materialize
from palimpsest.functions.ordered import running
from palimpsest.functions.text import block_piece, blocks, piece
from palimpsest.operators.reconcile import (
    LEVELS,
    LONG,
    STRING,
    boundary_map,
    mapped_documents,
    spread,
    unequal_documents,
)

# Context sizes, stop marks and batch limits.
CONTEXT_CHARS = 400
MAX_CONTEXT_CHARS = 500
CONTEXT_STOPS = "。！？!?\n"
MAX_CASES = 8
MAX_INPUT_BYTES = 48_000
ORDER_TAG = "candidate-order-v1"
#: Cases of one block of jumps, and characters of one slice of running sums: neither changes a batch.
PACK_BLOCK = 256
PACK_SLICE = 65_536

SOURCES = ("base", "a", "b", "peer")


def conflict_cases(texts: DataFrame, components: DataFrame, peer_hunks: DataFrame) -> DataFrame:
    """One row per conflict with the interval and text of every source; peer may be NULL."""
    conflicts = components.where(F.col("state") == "conflict")
    edges = conflicts.select(
        "doc_id",
        "start",
        "end",
        F.posexplode(F.array("start", "end")).alias("edge", "position"),
    )
    mapped = boundary_map(edges, peer_hunks, carry=("start", "end", "edge"))
    peer = mapped.groupBy("doc_id", "start", "end").agg(
        F.max(F.when(F.col("edge") == 0, F.col("mapped"))).alias("peer_start"),
        F.max(F.when(F.col("edge") == 1, F.col("mapped"))).alias("peer_end"),
        F.max(F.when(F.col("edge") == 1, F.col("mapped_after_insert"))).alias("peer_after"),
    )
    cut = spread(
        texts.select("doc_id", F.length("base").alias("size"), "base", "peer"), "doc_id"
    ).select("doc_id", "size", blocks(F.col("base")).alias("base"), blocks(F.col("peer")).alias("peer"))
    joined = spread(conflicts.join(peer, ["doc_id", "start", "end"]), "doc_id").join(cut, "doc_id")
    at_end = (F.col("end") == F.col("size")) | (F.col("start") == F.col("end"))
    right = F.when(at_end, F.col("peer_after")).otherwise(F.col("peer_end"))
    known = F.col("peer_start").isNotNull() & right.isNotNull()
    left_bound, right_bound = _context_bounds()
    wide = joined.select(
        "doc_id", "start", "end", "original",
        "a_start", "a_end", "a_text", "b_start", "b_end", "b_text",
        F.when(known, F.col("peer_start")).alias("peer_start"),
        F.when(known, right).alias("peer_end"),
        F.when(known, block_piece(F.col("peer"), F.col("peer_start"), right)).alias("peer_text"),
        left_bound.alias("context_left"),
        right_bound.alias("context_right"),
    )
    return wide.withColumn("case_id", _case_id())


CASE_FIELDS = (
    "start", "end", "original", "a_start", "a_end", "a_text",
    "b_start", "b_end", "b_text", "peer_start", "peer_end", "peer_text",
)


CONTEXT_FIELDS = (
    "source", "start", "end", "context_start", "context_end", "before", "target", "after",
)
_TEXTS = ("original", "a_text", "b_text", "peer_text")
_TEXT_FIELDS = ("source", "before", "target", "after")
CONTEXTS = (
    ArrayType(
        StructType(
            [StructField(c, StringType() if c in _TEXT_FIELDS else LongType()) for c in CONTEXT_FIELDS]
        )
    ),
    pa.list_(
        pa.struct([(c, pa.string() if c in _TEXT_FIELDS else pa.int64()) for c in CONTEXT_FIELDS])
    ),
)


#: `with_candidates`' candidates as a column of `mapped_documents`.
CANDIDATES = (
    ArrayType(
        StructType([
            StructField("candidate_id", StringType()), StructField("text", StringType()),
            StructField("sources", ArrayType(StringType())),
        ])
    ),
    pa.list_(
        pa.struct([("candidate_id", pa.string()), ("text", pa.string()), ("sources", pa.list_(pa.string()))])
    ),
)


def _digest(*fields: str | int | None) -> str:
    """The SHA-256 of `framed` fields, in hexadecimal."""
    parts = ("-" if field is None else f"{len(str(field))}:{field}" for field in fields)
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _candidates(case_id: str, texts: dict[str, str]) -> tuple[list[tuple], str]:
    """`with_candidates` of one case, given the text of every source, the base first: they and the kept one's id."""
    sources: dict[str, list[str]] = {}
    for source, text in texts.items():
        sources.setdefault(text, []).append(source)
    order = sorted(sources, key=lambda text: _digest(case_id, text, ORDER_TAG))
    rows = [(f"c{place}", text, sorted(sources[text])) for place, text in enumerate(order, 1)]
    return rows, f"c{order.index(texts['base']) + 1}"


def _case_id() -> Column:
    return text_id("case_", *[F.col(c) for c in CASE_FIELDS], size=24)


class _Images:
    """Base positions mapped through one document's sorted hunks, by the rules of `boundary_map`."""

    def __init__(self, hunks: Sequence[tuple[int, int, int, int]]):
        self._hunks = hunks
        # an insertion counts from its own position on, a replacement from the next one
        self._from = [start if start == end else start + 1 for start, end, _, _ in hunks]

    def at(self, position: int) -> tuple[bool, int, int]:
        """Whether it is inside a replacement, and its left and right image."""
        index = bisect_right(self._from, position) - 1
        if index < 0:
            return False, position, position
        start, end, left, right = self._hunks[index]
        if end > position > start:
            return True, left, right
        moved = position + right - end
        return False, left if start == position else moved, moved


def _context_range(base: str, start: int, end: int) -> tuple[int, int]:
    size = len(base)
    near_left, far_left = max(start - CONTEXT_CHARS, 0), max(start - MAX_CONTEXT_CHARS, 0)
    near_right, far_right = min(end + CONTEXT_CHARS, size), min(end + MAX_CONTEXT_CHARS, size)
    left = max(base.rfind(stop, far_left, near_left) for stop in CONTEXT_STOPS)
    first = max(near_right - 1, 0)
    stops = [at for at in (base.find(stop, first, far_right) for stop in CONTEXT_STOPS) if at >= 0]
    open_right = min(stops, default=far_right) - first
    return far_left if left < 0 else left + 1, min(near_right + open_right, far_right)


#: Octets of a code point below 128 as `to_json` writes it, as a table of `bytes.translate`.
_ASCII_OCTETS = bytes(
    2 if chr(c) in '"\\\b\t\n\f\r' else 6 if c < 32 else 1 for c in range(128)
) + bytes(128)


def _json_octets(text: str) -> np.ndarray:
    """How many octets the characters before each place (and all, at the end) take in JSON."""
    if text.isascii():
        own = np.frombuffer(text.encode().translate(_ASCII_OCTETS), np.uint8)
    else:
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        own = np.frombuffer(_ASCII_OCTETS, np.uint8)[np.minimum(codes, 127)]
        for width, above in ((2, 0x80), (3, 0x800), (4, 0x10000)):
            own[codes >= above] = width
    sums = np.zeros(len(own) + 1, np.int64)
    np.cumsum(own, out=sums[1:])
    return sums


def _is_conflict(component: Sequence[tuple[int, str]]) -> bool:
    return component[0][1] != component[1][1] != component[2][1] != component[0][1]


def _components_of(
    base: str, a: str, b: str, peer: str | None, levels: Sequence[str], contexts: bool
) -> Iterator[tuple]:
    """Rows of `CASE_FIELDS`, the context's range and its octets in JSON, the case's id, candidates and
    the kept one, of one document's components.

    With `contexts` of its conflicts only, and with the context's text in every source, in the order of
    the versions. What is not in conflict has no peer, no context and no candidates.
    """
    components = list(gaps((base, a, b), levels))
    if any(map(_is_conflict, components)):
        def images(found, side: int) -> _Images:
            return _Images(
                [(g[0][0], g[0][0] + len(g[0][1]), g[side][0], g[side][0] + len(g[side][1])) for g in found]
            )

        differs = peer is not None and peer != base
        through = {
            "base": _Images([]), "a": images(components, 1), "b": images(components, 2),
            "peer": images(gaps((base, peer), levels) if differs else [], 1),
        }
        whole = {"base": base, "a": a, "b": b, "peer": peer}
        octets = {source: _json_octets(text) for source, text in whole.items() if text is not None}
    for component in components:
        (start, original), (a_start, a_text), (b_start, b_text) = component
        end = start + len(original)
        row = [start, end, original, a_start, a_start + len(a_text), a_text, b_start, b_start + len(b_text), b_text]
        if not _is_conflict(component):
            if not contexts:
                yield (*row, *[None] * 7, (), None, len(original) + len(a_text) + len(b_text))
            continue
        hidden, peer_start, _ = through["peer"].at(start)
        lost, peer_end, peer_after = through["peer"].at(end)
        if end == len(base) or start == end:
            peer_end = peer_after
        known = not hidden and not lost
        row += (peer_start, peer_end, peer and peer[peer_start:peer_end]) if known else (None, None, None)
        left, right = _context_range(base, start, end)
        case_id = f"case_{_digest(*row)[:24]}"
        texts, spans, size = {}, [], 0
        for source, place in zip(SOURCES, (row[0:2], row[3:5], row[6:8], row[9:11])):
            text = whole[source]
            if place[0] is not None and text is not None:
                near, far = through[source].at(left)[1], through[source].at(right)[2]
                size += int(octets[source][far] - octets[source][near])
                texts[source] = text[place[0] : place[1]]
                spans.append((source, *place, near, far))
        row += (left, right, size, case_id, *_candidates(case_id, texts))
        if not contexts:
            yield (*row, 8 * len(original))
            continue
        around = [
            (source, f, t, near, far, whole[source][near:f], texts[source], whole[source][t:far])
            for source, f, t, near, far in sorted(spans, key=lambda span: _digest(case_id, span[0]))
        ]
        yield (*row, around, sum(len(c[5]) + len(c[7]) for c in around) + 8 * len(original))


def _in_one_pass(texts: DataFrame, levels: Sequence[str], contexts: bool) -> DataFrame:
    levels = tuple(levels)
    fields = [*CASE_FIELDS, "context_left", "context_right", "context_octets"]

    def build(doc_id, sides):
        return ((doc_id, *row) for row in _components_of(*sides, levels, contexts))

    return mapped_documents(
        unequal_documents(texts, ("base", "a", "b"), "doc_id", also=("peer",)),
        build,
        [
            *[(c, STRING if c in _TEXTS else LONG) for c in fields],
            ("case_id", STRING), ("candidates", CANDIDATES), ("keep_candidate_id", STRING),
            *[("contexts", CONTEXTS)] * contexts,
        ],
    )


def document_components(texts: DataFrame, *, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Components and the conflict cases among them, found in one pass over each document.

    `merge_states` makes merge_components of them and `conflict_rows` cases without contexts: the
    contexts are many times the texts, so only their size in JSON is kept, in `context_octets`.
    """
    return _in_one_pass(texts, levels, contexts=False)


def conflict_rows(components: DataFrame) -> DataFrame:
    """The rows of `document_components` that are conflict cases."""
    return components.where(F.col("context_left").isNotNull())


def document_cases(texts: DataFrame, *, levels: Sequence[str] = LEVELS) -> DataFrame:
    """`conflict_cases` with its candidates and `contexts` (one a source), found in one pass over each document.

    Equal to conflict_cases, context_windows and selection_cases over merge_components and the
    peer's diff_hunks; those serve stored components.
    """
    return _in_one_pass(texts, levels, contexts=True)


def complete_cases(cases: DataFrame) -> DataFrame:
    """`selection_cases` of rows that hold their own candidates and `contexts`: no exchange.

    Rows that hold only the size of their contexts get no `versions`, but the same `bytes`.
    """
    full = _versions(cases.withColumnRenamed("contexts", "v")) if "contexts" in cases.columns else cases
    # ids of versions and candidates are two characters long, whichever they are
    blank = F.struct(
        F.lit("v1").alias("version_id"), F.lit("c1").alias("candidate_id"),
        *[F.lit("").alias(c) for c in ("before", "target", "after")],
    )
    blanks = F.transform(_present(), lambda _: blank)
    return full.withColumn("bytes", _request_bytes(blanks) + F.col("context_octets")).drop("context_octets")


def _context_bounds() -> tuple[Column, Column]:
    base, start, end = F.col("base"), F.col("start"), F.col("end")
    near_left = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    far_left = F.greatest(start - MAX_CONTEXT_CHARS, F.lit(0))
    open_left = F.regexp_extract(
        block_piece(base, far_left, near_left), rf"[^{CONTEXT_STOPS}]*\z", 0
    )
    near_right = F.least(end + CONTEXT_CHARS, F.col("size"))
    far_right = F.least(end + MAX_CONTEXT_CHARS, F.col("size"))
    open_right = F.regexp_extract(
        block_piece(base, F.greatest(near_right - 1, F.lit(0)), far_right),
        rf"\A[^{CONTEXT_STOPS}]*",
        0,
    )
    return (
        (near_left - F.length(open_left)).cast("long"),
        F.least(near_right + F.length(open_right), far_right).cast("long"),
    )


def _present() -> Column:
    """(source, text) of the sources that cover the case, in fixed source order."""
    texts = (("base", "original"), ("a", "a_text"), ("b", "b_text"), ("peer", "peer_text"))
    entries = F.array(
        *[F.struct(F.lit(s).alias("source"), F.col(c).alias("text")) for s, c in texts]
    )
    return F.filter(entries, lambda e: e["text"].isNotNull())


def with_candidates(cases: DataFrame) -> DataFrame:
    """Exact-text candidates `c1..` in hash order, so that no source is recognisable by place."""
    case_id = F.col("case_id")

    def ranked(text: Column) -> Column:
        return F.struct(
            F.sha2(framed(case_id, text, F.lit(ORDER_TAG)), 256).alias("h"), text.alias("text")
        )

    present = F.col("present")
    ordered = F.array_sort(
        F.transform(F.array_distinct(F.transform(present, lambda e: e["text"])), ranked)
    )

    def candidate(entry: Column, index: Column) -> Column:
        same = F.filter(present, lambda e: e["text"] == entry["text"])
        return F.struct(
            F.concat(F.lit("c"), (index + 1).cast("string")).alias("candidate_id"),
            entry["text"].alias("text"),
            F.array_sort(F.transform(same, lambda e: e["source"])).alias("sources"),
        )

    return (
        cases.withColumn("present", _present())
        .withColumn("candidates", F.transform(ordered, candidate))
        .withColumn(
            "keep_candidate_id",
            F.filter("candidates", lambda c: c["text"] == F.col("original"))[0]["candidate_id"],
        )
        .drop("present")
    )


def candidate_rows(cases: DataFrame) -> DataFrame:
    return cases.select(
        "doc_id", "case_id", "keep_candidate_id", F.explode("candidates").alias("c")
    ).select(
        "doc_id",
        "case_id",
        "c.candidate_id",
        "c.text",
        "c.sources",
        (F.col("c.candidate_id") == F.col("keep_candidate_id")).alias("is_keep"),
    )


def context_windows(
    texts: DataFrame, components: DataFrame, peer_hunks: DataFrame, cases: DataFrame
) -> DataFrame:
    """Text around each case in every source that covers it, widened to mappable edges."""
    sides = F.array(
        *[
            F.struct(
                F.lit(s).alias("source"),
                F.col("start" if s == "base" else f"{s}_start").alias("from"),
                F.col("end" if s == "base" else f"{s}_end").alias("to"),
            )
            for s in SOURCES
        ]
    )
    wanted = cases.select(
        "doc_id", "case_id", "context_left", "context_right", F.explode(sides).alias("s")
    ).where(F.col("s.from").isNotNull())
    edges = wanted.select(
        "doc_id",
        F.col("s.source").alias("source"),
        "case_id",
        F.col("s.from").cast("long").alias("from"),
        F.col("s.to").cast("long").alias("to"),
        F.posexplode(F.array("context_left", "context_right")).alias("edge", "position"),
    )
    three_way = components.select(
        "doc_id", "start", "end",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("source"),
                        F.col(f"{s}_start").alias("variant_start"),
                        F.col(f"{s}_end").alias("variant_end"),
                    )
                    for s in ("a", "b")
                ]
            )
        ).alias("v"),
    ).select("doc_id", "v.source", "start", "end", "v.variant_start", "v.variant_end")
    peer = peer_hunks.select(
        "doc_id", F.lit("peer").alias("source"), "start", "end", "variant_start", "variant_end"
    )
    mapped = boundary_map(
        edges,
        three_way.unionByName(peer),
        keys=("doc_id", "source"),
        carry=("case_id", "from", "to", "edge"),
    )
    bounds = mapped.groupBy("doc_id", "source", "case_id", "from", "to").agg(
        F.max(F.when(F.col("edge") == 0, F.col("left_image"))).alias("context_start"),
        F.max(F.when(F.col("edge") == 1, F.col("right_image"))).alias("context_end"),
    )
    # one row per (document, source), so a row meets only the text it needs
    long = texts.select(
        "doc_id",
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("text")) for s in SOURCES])
        ).alias("t"),
    )
    cut = spread(long.select("doc_id", "t.source", "t.text"), "doc_id", "source").select(
        "doc_id", "source", blocks(F.col("text")).alias("cut")
    )
    joined = spread(bounds, "doc_id", "source").join(cut, ["doc_id", "source"])
    text = block_piece(F.col("cut"), F.col("context_start"), F.col("context_end"))
    joined = joined.withColumn("near", text).withColumns(
        {"left": F.col("from") - F.col("context_start"), "right": F.col("to") - F.col("context_start")}
    )
    return joined.select(
        "doc_id",
        "case_id",
        "source",
        F.col("from").alias("start"),
        F.col("to").alias("end"),
        "context_start",
        "context_end",
        piece(F.col("near"), F.lit(0), F.col("left")).alias("before"),
        piece(F.col("near"), F.col("left"), F.col("right")).alias("target"),
        piece(F.col("near"), F.col("right"), F.length("near")).alias("after"),
    )


def selection_cases(cases: DataFrame, contexts: DataFrame) -> DataFrame:
    """Complete cases: candidates, hash-ordered versions `v1..`, request text and its size."""
    grouped = contexts.groupBy("doc_id", "case_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.sha2(framed(F.col("case_id"), F.col("source")), 256).alias("h"),
                    "source", "start", "end", "context_start", "context_end",
                    "before", "target", "after",
                )
            )
        ).alias("v")
    )

    full = _versions(with_candidates(cases).join(grouped, ["doc_id", "case_id"]))
    return full.withColumn("bytes", _request_bytes(F.col("versions")))


def _versions(joined: DataFrame) -> DataFrame:
    def version(v: Column, index: Column) -> Column:
        return F.struct(
            F.concat(F.lit("v"), (index + 1).cast("string")).alias("version_id"),
            F.filter("candidates", lambda c: c["text"] == v["target"])[0]["candidate_id"].alias(
                "candidate_id"
            ),
            v["source"].alias("source"),
            v["start"].alias("start"),
            v["end"].alias("end"),
            v["context_start"].alias("context_start"),
            v["context_end"].alias("context_end"),
            v["before"].alias("before"),
            v["target"].alias("target"),
            v["after"].alias("after"),
        )

    return joined.withColumn("versions", F.transform("v", version)).drop("v")


def _request_bytes(versions: Column) -> Column:
    """Octets of a case's request text."""
    request = F.struct(
        F.col("case_id"),
        F.transform(
            "candidates", lambda c: F.struct(c["candidate_id"].alias("candidate_id"),
                                             c["text"].alias("text"))
        ).alias("candidates"),
        F.transform(
            versions,
            lambda v: F.struct(
                v["version_id"].alias("version_id"),
                v["candidate_id"].alias("candidate_id"),
                v["before"].alias("before"),
                v["target"].alias("target"),
                v["after"].alias("after"),
            ),
        ).alias("versions"),
        F.col("keep_candidate_id"),
    )
    return F.octet_length(F.to_json(request)).cast("long")


def _jumps(sums: Column, own: Column, room: int, max_cases: int) -> Column:
    """For each of a block's cases (places from 1): the place of the case that opens the next batch.

    `sums` are running sums of a case's bytes and its comma, those of the next block's first cases too.
    """

    def jumps(block: Column) -> Column:
        def jump(case: Column, index: Column) -> Column:
            reach = case["total"] - case["taken"] + room
            ahead = F.sequence(index + 1, index + max_cases)
            fitting = F.filter(ahead, lambda place: F.try_element_at(block["sums"], place) <= reach)
            return index + 1 + F.size(fitting)

        return F.transform(block["own"], jump)

    # Bound by a lambda, the arrays are built once a block; inside `jump` they would be built once a case.
    return F.transform(F.array(F.struct(sums.alias("sums"), own.alias("own"))), jumps)[0]


def _exits(jumps: Column, rounds: int) -> Column:
    """Jumps followed to the end of their block by pointer doubling: `to` and the batches on the way."""
    zero = F.struct(jumps.alias("to"), F.transform(jumps, lambda _: F.lit(1)).alias("hops"))

    def double(state: Column, _: Column) -> Column:
        def onward(name: str, past: Column | None):
            return lambda t: F.coalesce(F.try_element_at(state[name], t), t if past is None else past)

        hops = F.transform(state["to"], onward("hops", F.lit(0)))
        return F.struct(
            F.transform(state["to"], onward("to", None)).alias("to"),
            F.zip_with(state["hops"], hops, lambda x, y: x + y).alias("hops"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), zero, double)


def _entries(blocks: Column) -> Column:
    """Where the batches enter each block of a document, and how many batches opened before it."""
    entry = "struct<block:bigint,entry:int,opened:int>"
    zero = F.struct(
        F.lit(1).alias("entry"), F.lit(0).alias("opened"),
        F.expr(f"cast(array() as array<{entry}>)").alias("out"),
    )

    def step(state: Column, block: Column) -> Column:
        own = F.struct(block["block"].alias("block"), state["entry"].alias("entry"), state["opened"].alias("opened"))
        return F.struct(
            (F.try_element_at(block["to"], state["entry"]) - block["cases"]).alias("entry"),
            (state["opened"] + F.try_element_at(block["hops"], state["entry"])).alias("opened"),
            F.array_append(state["out"], own).alias("out"),
        )

    return F.aggregate(blocks, zero, step)["out"]


def _numbers(jumps: Column, entry: Column, opened: Column) -> Column:
    """The batch number of every case of a block that batches enter at `entry`."""
    zero = F.struct(
        entry.alias("opens"), opened.alias("batch"), F.expr("cast(array() as array<int>)").alias("out")
    )

    def step(state: Column, jump: Column) -> Column:
        opens = F.size(state["out"]) + 1 == state["opens"]
        batch = state["batch"] + F.when(opens, 1).otherwise(0)
        return F.struct(
            F.when(opens, jump).otherwise(state["opens"]).alias("opens"),
            batch.alias("batch"),
            F.array_append(state["out"], batch).alias("out"),
        )

    return F.aggregate(jumps, zero, step)["out"]


def budget_batches(
    cases: DataFrame, *, max_cases: int = MAX_CASES, max_bytes: int = MAX_INPUT_BYTES,
    block_cases: int = PACK_BLOCK,
) -> DataFrame:
    """Greedy, order-preserving packing: `doc_id, case_id, start, end, bytes, batch_no`.

    A case too big on its own (or of unknown size) gets `batch_no` NULL and leaves the open batch open.
    Which case opens the next batch depends on running sums alone, so every case has a jump. Blocks of
    cases follow their jumps in parallel; one small row a block then tells where batches enter it. No
    document is gathered: of one with n cases, n / `block_cases` such rows meet in a task.
    """
    wrapper = len('{"cases":[]}')
    width = max(block_cases, max_cases)
    fits = F.coalesce(F.col("bytes") + wrapper <= max_bytes, F.lit(False))
    rows = cases.select("doc_id", "case_id", "start", "end", "bytes")
    order = ["start", "end", "case_id", "bytes"]
    placed = running(
        rows.where(fits).select(
            F.struct("doc_id").alias("doc"), *order, F.floor(F.col("start") / PACK_SLICE).alias("part")
        ),
        ["doc"], order, "part",
        place=("sum", F.lit(1)),
        total=("sum", F.col("bytes").cast("long") + 1),
    )
    case = F.struct("place", "total", (F.col("bytes").cast("long") + 1).alias("taken"), *order)
    block = F.floor((F.col("place") - 1) / width).alias("block")
    grouped = placed.groupBy("doc", block).agg(F.sort_array(F.collect_list(case)).alias("own"))
    totals = F.transform("own", lambda c: c["total"])
    following = F.lead(F.slice(totals, 1, max_cases)).over(Window.partitionBy("doc").orderBy("block"))
    sums = F.concat(totals, F.coalesce(following, F.expr("cast(array() as array<bigint>)")))
    jumping = grouped.withColumn("sums", sums).withColumn(
        "jumps", _jumps(F.col("sums"), F.col("own"), max_bytes - wrapper + 1, max_cases)
    ).drop("sums")
    ends = _exits(F.col("jumps"), max(1, math.ceil(math.log2(width))))
    steps = jumping.select("doc", "block", F.size("own").alias("cases"), ends.alias("ends")).select(
        "doc", "block", "cases",
        *[F.slice(F.col("ends")[name], 1, max_cases).alias(name) for name in ("to", "hops")],
    )
    entries = (
        steps.groupBy("doc")
        .agg(F.sort_array(F.collect_list(F.struct("block", "cases", "to", "hops"))).alias("blocks"))
        .select("doc", F.inline(_entries(F.col("blocks"))))
    )
    numbered = (
        jumping.join(entries, ["doc", "block"])
        .select("doc", "own", _numbers(F.col("jumps"), F.col("entry"), F.col("opened")).alias("number"))
        .select("doc", F.explode(F.arrays_zip("own", "number")).alias("z"))
    )
    packed = numbered.select(
        "doc.doc_id", "z.own.case_id", "z.own.start", "z.own.end", "z.own.bytes", F.col("z.number").alias("batch_no")
    )
    return packed.unionByName(rows.where(~fits).withColumn("batch_no", F.lit(None).cast("int")))


def batch_ids(batches: DataFrame) -> DataFrame:
    """Give every batch a content-derived id from its document and ordered case ids."""
    ids = (
        batches.where(F.col("batch_no").isNotNull())
        .groupBy("doc_id", "batch_no")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "case_id"))).alias("c"))
        .select(
            "doc_id",
            "batch_no",
            text_id(
                "batch_",
                F.col("doc_id"),
                F.array_join(F.transform("c", lambda c: c["case_id"]), ","),
                size=24,
            ).alias("batch_id"),
        )
    )
    place = Window.partitionBy("doc_id", "batch_no").orderBy("start", "end")
    return batches.join(ids, ["doc_id", "batch_no"], "left").withColumn(
        "place",
        F.when(F.col("batch_no").isNotNull(), F.row_number().over(place)),
    )


def decision_coverage(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per batch: fault counts; `valid` only if each case is decided once, by a known candidate.

    cases: doc_id, batch_id, case_id, candidate_ids; decisions: doc_id, batch_id, case_id,
    candidate_id.
    """
    keys = ["doc_id", "batch_id", "case_id"]
    options = cases.select(*keys, F.explode("candidate_ids").alias("candidate_id")).withColumn(
        "offered", F.lit(True)
    )
    counted = decisions.groupBy(*keys, "candidate_id").agg(F.count(F.lit(1)).alias("n"))
    given = (
        counted.join(options, [*keys, "candidate_id"], "left")
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("uses"),
            F.count_if(F.col("offered").isNull()).alias("strangers"),
        )
    )
    both = cases.withColumn("known", F.lit(True)).join(given, keys, "full_outer")
    known = F.col("known").isNotNull()
    uses = F.coalesce(F.col("uses"), F.lit(0))
    report = both.groupBy("doc_id", "batch_id").agg(
        F.count_if(known).alias("cases"),
        F.sum(uses).alias("decisions"),
        F.count_if(known & (uses == 0)).alias("missing"),
        F.count_if(uses > 1).alias("duplicated"),
        F.count_if(~known).alias("unknown_case"),
        F.count_if(known & (F.col("strangers") > 0)).alias("unknown_candidate"),
    )
    faults = (
        F.col("missing") + F.col("duplicated") + F.col("unknown_case")
        + F.col("unknown_candidate")
    )
    return report.withColumn("valid", faults == 0)


def set_equality(expected: DataFrame, given: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Do the given ids equal the expected ids as a set, each exactly once?"""
    by = [*keys, item]
    left = expected.groupBy(*by).agg(F.count(F.lit(1)).alias("wanted"))
    right = given.groupBy(*by).agg(F.count(F.lit(1)).alias("got"))
    both = left.join(right, by, "full_outer")
    return both.groupBy(*keys).agg(
        F.count_if(F.col("got").isNull()).alias("missing"),
        F.count_if(F.col("wanted").isNull()).alias("extra"),
        F.bool_and(F.col("got").isNotNull() & F.col("wanted").isNotNull()).alias("same_set"),
        F.bool_and(F.coalesce(F.col("got"), F.lit(0)) <= 1).alias("unique_ids"),
    )


def apply_selections(cases: DataFrame, coverage: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions of valid batches as patches that carry the frozen candidate text."""
    valid = coverage.where("valid").select("doc_id", "batch_id")
    chosen = decisions.join(valid, ["doc_id", "batch_id"], "left_semi")
    joined = chosen.join(cases, ["doc_id", "batch_id", "case_id"])
    text = F.filter("candidates", lambda c: c["candidate_id"] == F.col("candidate_id"))[0]["text"]
    return joined.select(
        "doc_id", "start", "end", "original", text.alias("replacement"),
        F.lit("selection").alias("resolution"), "case_id", "candidate_id",
    )


def judged_cases(cases: DataFrame) -> DataFrame:
    """Frozen cases with `own`, the codes of the rules that each breaks by itself.

    Reads `start, end, original, keep_candidate_id, candidates, versions`, so that none of them, and no
    context, has to meet its batch.
    """
    return cases.withColumn("own", _codes(_case_rules()))


def batch_audit(batches: DataFrame) -> DataFrame:
    """Violation codes of frozen batches, one row per case that breaks a rule.

    Expects one row per case with `batch_id, place, case_id, prompt, prompt_sha256` and either `own` of
    `judged_cases` or what that reads.
    """
    frozen = batches if "own" in batches.columns else judged_cases(batches)
    prompt = ("prompt_hash", F.col("prompt_sha256") != F.concat(F.lit("sha256:"), F.sha2(F.col("prompt"), 256)))
    judged = materialize(
        frozen.select(
            "doc_id", "batch_id", "place", "case_id", F.concat("own", _codes([prompt])).alias("own")
        )
    )
    by_batch = judged.groupBy("doc_id", "batch_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_distinct("case_id").alias("ids"),
        F.sort_array(F.collect_list(F.struct("place", "case_id"))).alias("c"),
    )
    core = by_batch.select(
        "doc_id",
        "batch_id",
        ((F.col("size") < 1) | (F.col("size") > MAX_CASES)).alias("bad_size"),
        (F.col("ids") != F.col("size")).alias("bad_ids"),
        (
            F.col("batch_id")
            != text_id(
                "batch_",
                F.col("doc_id"),
                F.array_join(F.transform("c", lambda c: c["case_id"]), ","),
                size=24,
            )
        ).alias("bad_batch_id"),
    )
    rules = (
        ("batch_size", F.col("bad_size")),
        ("duplicate_case", F.col("bad_ids")),
        ("batch_identity", F.col("bad_batch_id")),
    )
    return (
        judged.join(core, ["doc_id", "batch_id"])
        .select("doc_id", "batch_id", "case_id", F.concat(_codes(rules), F.col("own")).alias("codes"))
        .where(F.size("codes") > 0)
    )


def _codes(rules: Sequence[tuple[str, Column]]) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(code)) for code, rule in rules])
    )


def _case_rules() -> tuple[tuple[str, Column], ...]:
    """The rules that a frozen case breaks or keeps by itself."""
    texts = F.transform("candidates", lambda c: c["text"])
    ids = F.transform("candidates", lambda c: c["candidate_id"])
    options = F.size("candidates")
    keep = F.filter("candidates", lambda c: c["candidate_id"] == F.col("keep_candidate_id"))
    target_fault = F.exists(
        "versions",
        lambda v: ~F.exists(
            "candidates",
            lambda c: (c["candidate_id"] == v["candidate_id"]) & (c["text"] == v["target"]),
        ),
    )
    context_fault = F.exists(
        "versions",
        lambda v: (v["context_start"] < 0)
        | (v["context_start"] > v["start"])
        | (v["start"] > v["end"])
        | (v["end"] > v["context_end"])
        | (F.length(v["before"]) != v["start"] - v["context_start"])
        | (F.length(v["target"]) != v["end"] - v["start"])
        | (F.length(v["after"]) != v["context_end"] - v["end"]),
    )
    length_fault = (
        (F.col("start") < 0)
        | (F.col("start") > F.col("end"))
        | (F.length("original") != F.col("end") - F.col("start"))
    )
    return (
        (
            "candidate_set",
            (options < 2)
            | (options > 4)
            | (F.size(F.array_distinct(texts)) != options)
            | (F.size(F.array_distinct(ids)) != options),
        ),
        ("keep_not_original", (F.size(keep) == 0) | (F.get(keep, F.lit(0))["text"] != F.col("original"))),
        ("core_interval", length_fault),
        ("version_target", target_fault),
        ("version_context", context_fault),
    )
