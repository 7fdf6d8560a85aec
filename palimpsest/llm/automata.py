"""Substring dedup by suffix automata of reference shards.

A window is a run of `window` words. A word goes if a window over it also starts in a document of smaller
id. Automata of the whole corpus cannot be sent to every document, so both meet in shards:

1. *Anchors.* Among the word runs of `GRAM` words inside a window the one of least hash is its anchor. Equal
   windows have equal anchors. Windows in a row with one anchor form a segment; texts emit a small row a
   different segment with all its places, so a text that repeats itself costs what it says once, and anchors
   seen in one document only are dropped.
2. *Forms.* Equal segments are one form from here on, with its smallest and largest document; copies and shared passages
   cost one form each, and what is decided about a form's windows is joined to its rows once, at the end.
3. *Shards.* The smallest document of a form is a reference. The references are dealt by anchor to shards of about `SHARD_WORDS` words: a bounded automaton each, built
   where it is used. The forms of an anchor with very many are halved by the place of the
   anchor in the window, until the words that the windows of a half share tell the texts apart: no shard grows
   with a hot phrase, and halves that stand in one document only leave.
4. *Matching statistics.* A shard builds the suffix automaton of its references, with the smallest document
   of every state, and streams the segments of the documents through it: at every word the state of the
   longest match is cut to `window` words, and its smallest document decides about that window.
5. Spans of a document are merged and removed in one pass over the texts; texts without any never move.

Defined results: null, empty and short texts lose nothing; words are kept as they are, joined by one space;
overlapping windows inside one document do not count, only those of smaller ids; equal rows of one id are
treated alike; rows without an id lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize
from palimpsest.llm.sieve import maybe, sieve
from palimpsest.llm.words import give_back, gram_hashes, mixed, run_hashes, slices, texts_of, tidied, word_hashes, words_of

WINDOW = 50
GRAM = 16
SHARD_WORDS = 60_000
#: Different segments of one anchor above which they are halved.
HOT_SEGMENTS = 400
_PLACE = np.uint64((1 << 28) - 1)


def _segments(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For all texts of a slice: anchor's place, segment hash, first window and number of windows of every segment."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none.astype(np.uint64), none, none
    grams = gram_hashes(hashes, GRAM)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)  # equal hashes: the first place wins
    reach, span = 1, window - GRAM + 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(owner[: len(hashes) - window + 1] == owner[window - 1 :])
    if not len(start):
        return none, none.astype(np.uint64), none, none
    anchor = (least[start] & _PLACE).astype(np.int64)
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(fresh)
    number = np.diff(np.append(begin, len(start)))
    at = start[begin]
    return anchor[begin], run_hashes(hashes, at, at + number + window - 1), at, number


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts_of(column)
    words = words_of(texts)
    return word_hashes(texts, words), words.first


def _folded(owner: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of one text that are equal lie together: their order, and where each group begins in it (one more at the end).

    Groups follow their first segment, and the segments of a group their places.
    """
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    order = np.lexsort((anchor, content, owner))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any([key[order[1:]] != key[order[:-1]] for key in (owner, anchor, content)], axis=0)
    begin = np.flatnonzero(fresh)
    leader = np.empty(len(order), np.int64)
    leader[order] = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
    order = leader.argsort(kind="stable")
    _, first = np.unique(leader[order], return_index=True)
    return order, np.append(first, len(order))


_SEGMENT = ["anchor", "content", "doc_id", "start", "number", "at"]
#: What a form keeps when it is cut: its largest document, and the segment it was cut from with its first word.
_ORIGIN = ["most", "root_anchor", "root_content", "origin"]


def segments(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every different segment of every whole text: `anchor, content, doc_id, number`, the anchor's place `into` it and all its `starts`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, first = _hashed(part.column("text"))
                place, content, start, number = _segments(hashes, first, window)
                owner = np.searchsorted(first, start, "right") - 1
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                anchor = gram_hashes(hashes, GRAM)[place] if len(place) else content
                order, begin = _folded(owner, anchor, content)
                one = order[begin[:-1]]
                columns = [anchor[one].view(np.int64), content[one].view(np.int64), ids[owner[one]], number[one], (place - start)[one]]
                starts = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array((start - first[owner])[order], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), starts], [*names, "starts"])

    names = ["anchor", "content", "doc_id", "number", "into"]
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return chosen.mapInArrow(tidied(run), ", ".join(f"{c} long" for c in names) + ", starts array<long>")


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`doc_id, text, spans` of the documents that have spans; other texts are not shuffled."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    asked = maybe(chosen, F.col("doc_id"), sieve(spans, "doc_id")).where("`~maybe`").select("doc_id", "text")
    return asked.join(spans, "doc_id")


def _halves(docs: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """Forms of hot anchors, cut in two by the place of the anchor in the window, from the text of their document.

    The windows of a half have more words in common than the anchor; these and the half are their new anchor.
    Equal windows stay together, since the place of the anchor is part of the window.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, first = _hashed(part.column("text"))
                spans = part.column("spans")
                lists = np.diff(spans.offsets.to_numpy())
                flat = spans.flatten()
                span = {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}
                doc = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), lists)
                base, size = np.repeat(first[:-1], lists), np.repeat(np.diff(first), lists)
                middle, newest = (span["low"] + span["high"]) // 2, span["at"] - span["start"]
                for low, high in ((span["low"], middle), (middle, span["high"])):
                    begin = np.maximum(low, newest - span["number"] + 1)
                    end = np.minimum(high, newest + 1)
                    start, number = span["at"] - end + 1, end - begin
                    core = span["at"] - low, span["at"] - high + 1 + window
                    fine = (number > 0) & (start >= 0) & (start + number + window - 1 <= size)
                    place = base[fine]
                    key = run_hashes(hashes, place + core[0][fine], place + core[1][fine])
                    key = mixed(key ^ (low[fine].astype(np.uint64) << np.uint64(32)) ^ high[fine].astype(np.uint64))
                    content = run_hashes(hashes, place + start[fine], place + (start + number + window - 1)[fine])
                    columns = [key.view(np.int64), content.view(np.int64), doc[fine], start[fine], number[fine], span["at"][fine], low[fine], high[fine]]
                    columns += [span[c][fine] for c in _ORIGIN]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = [*_SEGMENT, "low", "high", *_ORIGIN]
    spans = hot.groupBy("doc_id").agg(F.collect_list(F.struct("start", "number", "at", "low", "high", *_ORIGIN)).alias("spans"))
    return _with_spans(docs, spans).mapInArrow(tidied(run), ", ".join(f"{c} long" for c in names))


def _forms(found: DataFrame) -> DataFrame:
    """Different segments, each with its smallest document (and its place there) and its largest one."""
    # the anchor of equal words has one place in them, so any row tells it
    folded = found.groupBy("anchor", "content").agg(
        F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most"), F.min_by(F.col("starts")[0], "doc_id").alias("start"),
        F.first("number").alias("number"), F.first("into").alias("into"),
    )
    return materialize(folded.withColumn("at", F.col("start") + F.col("into")).drop("into"))


def _shared(forms: DataFrame) -> DataFrame:
    """The forms whose anchor stands in two documents at least."""
    by_anchor = forms.groupBy("anchor").agg(F.min("doc_id").alias("one"), F.max("most").alias("other"))
    shared = materialize(by_anchor.where("one < other").select("anchor"))
    likely = maybe(forms, F.col("anchor"), sieve(shared, "anchor")).where("`~maybe`").drop("~maybe")
    return materialize(likely.join(shared, "anchor"))


def _reference_words(docs: DataFrame, references: DataFrame, window: int) -> DataFrame:
    """`shard, anchor, content, owner, words` (64-bit word hashes) of every reference segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, first = _hashed(part.column("text"))
                rows = []
                for i, (doc, spans) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("spans").to_pylist(), strict=True)):
                    own = hashes[first[i] : first[i + 1]]
                    for s in spans:
                        words = own[s["start"] : s["start"] + s["number"] + window - 1]
                        rows.append((s["shard"], s["anchor"], s["content"], doc, words.tobytes()))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                names = ["shard", "anchor", "content", "owner", "words"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    span = F.struct("shard", "anchor", "content", "start", "number")
    spans = references.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list(span).alias("spans"))
    return _with_spans(docs, spans).mapInArrow(tidied(run), "shard int, anchor long, content long, owner long, words binary")


class Automaton:
    """Suffix automaton of several sequences; every state knows the smallest owner of its occurrences."""

    def __init__(self, sequences: list[list[int]], owners: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [None]
        for sequence, owner in zip(sequences, owners, strict=True):
            last = 0
            for word in sequence:
                last = self._extend(last, word)
                held = self.low[last]
                if held is None or owner < held:
                    self.low[last] = owner
        # occurrences of a state are those of the states that link to it
        low, link = self.low, self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up, own = link[state], low[state]
            if own is not None and (low[up] is None or own < low[up]):
                low[up] = own

    def _extend(self, last: int, word: int) -> int:
        moves, link, length, low = self.next, self.link, self.length, self.low
        onto = moves[last].get(word)
        if onto is not None:
            return onto if length[onto] == length[last] + 1 else self._split(last, word, onto)
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        low.append(None)
        at = last
        while at >= 0 and word not in moves[at]:
            moves[at][word] = new
            at = link[at]
        if at >= 0:
            onto = moves[at][word]
            link[new] = onto if length[onto] == length[at] + 1 else self._split(at, word, onto)
        return new

    def _split(self, at: int, word: int, onto: int) -> int:
        """A state of its own for the shorter suffixes of `onto` that `at` extends to."""
        moves, link = self.next, self.link
        copy = len(moves)
        moves.append(dict(moves[onto]))
        self.length.append(self.length[at] + 1)
        link.append(link[onto])
        self.low.append(None)
        link[onto] = copy
        while at >= 0 and moves[at].get(word) == onto:
            moves[at][word] = copy
            at = link[at]
        return copy

    def lowest(self, sequence: list[int], window: int) -> list[int | None]:
        """For every window of the sequence the smallest owner of its occurrences (None: nowhere)."""
        moves, link, length, low = self.next, self.link, self.length, self.low
        state, matched, out = 0, 0, []
        for place, word in enumerate(sequence):
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            if word in moves[state]:
                state = moves[state][word]
                matched += 1
            while length[link[state]] >= window if state else False:
                state = link[state]
                matched = length[state]
            if place >= window - 1:
                out.append(low[state] if matched >= window else None)
        return out


def _match(window: int):
    def match(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["anchor", "content"]).sort_values(["owner", "anchor", "content"])
        raw = [np.frombuffer(w, np.uint64) for w in group["words"]]
        _, small = np.unique(np.concatenate(raw), return_inverse=True)
        cut = np.cumsum([len(w) for w in raw])[:-1]
        sequences = [s.tolist() for s in np.split(small, cut)]
        automaton = Automaton(sequences, group["owner"].tolist())
        out = []
        for anchor, content, sequence in zip(group["anchor"], group["content"], sequences, strict=True):
            found = automaton.lowest(sequence, window)
            begin = 0
            for i in range(1, len(found) + 1):
                if i == len(found) or found[i] != found[begin]:
                    if found[begin] is not None:
                        out.append((anchor, content, begin, i, found[begin]))
                    begin = i
        automaton = sequences = raw = None
        give_back()
        return pd.DataFrame(out, columns=["anchor", "content", "from", "to", "low"]).astype("int64")

    return match


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`doc_id, spans`: word spans [start, end) that windows of smaller documents cover, a row per such document."""
    found = materialize(segments(docs, window))
    whole = {"low": F.lit(0).cast("long"), "high": F.lit(window - GRAM + 1).cast("long")}
    roots = {"root_anchor": F.col("anchor"), "root_content": F.col("content"), "origin": F.col("start")}
    met = _shared(_forms(found)).withColumns(whole | roots)
    settled = []
    while True:
        # different segments of an anchor, not its rows, make a shard grow
        forms = met.groupBy("anchor", "content").agg(F.lit(1).alias("one")).groupBy("anchor").agg(F.count("one").alias("forms"))
        hot = materialize(forms.where(F.col("forms") > HOT_SEGMENTS).select("anchor", F.lit(True).alias("hot")))
        if hot.isEmpty():
            settled.append(met)
            break
        told = met.join(hot, "anchor", "left")
        settled.append(materialize(told.where("hot is null").drop("hot")))
        met = _shared(materialize(_halves(docs, told.where("hot"), window)))
    parts = materialize(reduce(DataFrame.unionByName, settled).drop("at", "low", "high"))
    references = parts.groupBy("anchor", "content").agg(
        F.min("doc_id").alias("owner"),
        F.min_by("start", "doc_id").alias("start"), F.first("number").alias("number"),
    )
    words = references.agg(F.sum(F.col("number") + window - 1)).first()[0] or 0
    shard: Column = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-words // SHARD_WORDS)))).cast("int")
    texts = _reference_words(docs, references.withColumn("shard", shard), window)
    lows = texts.groupBy("shard").applyInPandas(_match(window), "anchor long, content long, from long, to long, low long")
    # windows of whole forms: a part begins so many words behind its form
    shift = F.col("start") - F.col("origin")
    hits = parts.join(lows, ["anchor", "content"]).where("low < most").select(
        F.col("root_anchor").alias("anchor"), F.col("root_content").alias("content"), "low",
        (shift + F.col("from")).alias("from"), (shift + F.col("to") + window - 1).alias("to"),
    )
    # a row a form, with at most as many entries as it has windows: copies of a form meet one row, not every hit, and a
    # document that says a form many times meets it once
    listed = hits.groupBy("anchor", "content").agg(F.collect_set(F.struct("low", "from", "to")).alias("hits"))
    listed = materialize(listed)
    rows = maybe(found, F.col("content"), sieve(listed, "content")).where("`~maybe`").select("anchor", "content", "doc_id", "starts")
    earlier = F.filter("hits", lambda h: h["low"] < F.col("doc_id"))
    placed = lambda at: F.transform(earlier, lambda h: F.struct((at + h["from"]).alias("start"), (at + h["to"]).alias("end")))
    copies = rows.join(listed, ["anchor", "content"]).where(F.size(earlier) > 0)
    hit = copies.select("doc_id", F.flatten(F.transform("starts", placed)).alias("spans"))
    return hit.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def _cleaned(docs: DataFrame, spans: DataFrame, run, schema) -> DataFrame:
    """`run` over the rows of `docs` with their spans in a column `~spans` (null: none)."""
    spans = materialize(spans)
    marked = maybe(docs, F.col("doc_id").cast("long"), sieve(spans, "doc_id"))
    nothing = F.lit(None).cast(spans.schema["spans"].dataType)
    still = marked.where("not `~maybe`").drop("~maybe").withColumn("~spans", nothing)
    known = spans.select(F.col("doc_id").alias("~id"), F.col("spans").alias("~spans"))
    moved = marked.where("`~maybe`").drop("~maybe").join(known, F.col("doc_id").cast("long") == F.col("~id"), "left").drop("~id")
    return still.unionByName(moved).mapInArrow(tidied(run), schema)


def _keep(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """The words outside all spans."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] > at:
            out += words[at : s["start"]]
        at = max(at, s["end"])
    return out + words[at:]


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256` of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("~spans").to_pylist(), strict=True):
                words = (text or "").encode().split()  # bytes split at exactly the separators
                kept = _keep(words, spans) if spans else words
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return _cleaned(chosen, repeated_spans(chosen, window), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` with removed words cut from `text`; texts that lose nothing stay byte for byte.

    `n_chars`, where there is one, follows the text. Every row stays, also one that loses all its words.
    """
    schema = docs.schema
    names = [f.name for f in schema]
    place = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = batch.column("text").to_pylist(), [batch.column(c) for c in names]
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in names else None
            for i, spans in enumerate(batch.column("~spans").to_pylist()):
                if spans and texts[i] is not None:
                    texts[i] = b" ".join(_keep(texts[i].encode().split(), spans)).decode()
                    if sizes:
                        sizes[i] = len(texts[i])
            columns[place] = pa.array(texts, columns[place].type)
            if sizes:
                columns[names.index("n_chars")] = pa.array(sizes, batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return _cleaned(docs, repeated_spans(docs, window), run, schema)
