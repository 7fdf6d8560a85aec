"""Source divergence audit over a minimal acyclic transducer of the vocabulary.

1. Document frequencies: texts are cut into terms in the tasks that read them, and one row per term and task is summed.
   Terms in at least `LEAST_DOCS` documents of a language are kept and ranked in byte order; the rank is the ordinal.
2. The kept terms of a language are dealt to shards of about `SHARD_TERMS`; a task builds each shard's minimal acyclic
   transducer from its sorted terms. A path's outputs add up to the number of smaller terms, which leads to the ordinal.
3. Texts are streamed through the transducers and terms are recounted by ordinal. Transducers whose packed size is at
   most `MOST_BYTES` together are broadcast; beyond that, terms summed per task go to their shard's task instead. Both
   ways give the same counts.
4. Smoothed shares of a group and of its language are whole numbers, computed in decimals. Terms over the language's
   share are ranked by the excess and their ordinal; pairs of sources are compared in blocks of sources and terms.

Defined results: null text, language and source are empty texts; a group without kept terms has pairs of its base
shares; a language without kept terms has pairs of value 0 and no terms; very long texts and repeated rows count in full; null ids
and extra columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize
from palimpsest.llm.ranks import places
from palimpsest.llm.words import lowered, slices, texts_of, words_of

LEAST_DOCS = 30
#: Terms of a group that are reported.
TOP_TERMS = 50
#: Scale of a share, and what is added to every count.
UNIT, ADDED = 1_000_000_000, 5
#: Terms of one transducer, and bytes of all transducers that are broadcast.
SHARD_TERMS = 50_000
MOST_BYTES = 32_000_000
#: Entries a task holds before it hands them on.
HELD = 300_000
#: Sources and terms of one block of the comparison.
SOURCE_BLOCK, TERM_BLOCK = 128, 2048

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


class Transducer:
    """Terms to their ranks. State 0 is the root; arcs lie in a table found by hashing (state, byte)."""

    def __init__(self, arcs: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray, ordinals: np.ndarray):
        self.packed = {"arcs": arcs, "targets": targets, "outputs": outputs, "final": final, "ordinals": ordinals}
        self.final, self.ordinals = final, ordinals
        size = 1 << max(4, int(4 * max(len(arcs), 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - (size.bit_length() - 1)), size - 1
        self.keys, self.slots = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.targets, self.outputs = np.append(targets, 0), np.append(outputs, 0)
        left, slot = np.arange(len(arcs)), self._slot(arcs)
        while len(left):  # linear probing, one arc a slot
            free = self.keys[slot] < 0
            _, taken = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            taken = taken[free[taken]]
            self.keys[slot[taken]], self.slots[slot[taken]] = arcs[left[taken]], left[taken]
            rest = np.ones(len(left), bool)
            rest[taken] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, arcs: np.ndarray) -> np.ndarray:
        return ((arcs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _arcs(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Arc numbers, -1 where a state has no such arc."""
        want = state << 8 | byte
        slot = self._slot(want)
        held = self.keys[slot]
        out = np.where(held == want, self.slots[slot], -1)
        left = np.flatnonzero((held != want) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[slot[left]]
            hit = held == want[left]
            out[left[hit]] = self.slots[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def ordinals_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ordinals of all words `data[start:end]`, read byte by byte in step; -1 for words that are no terms."""
        out = np.full(len(start), -1, np.int64)
        word, at, state, rank = np.arange(len(start)), start, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        while len(word):
            over = at == end[word]
            if over.any():
                ends = over & self.final[state]
                out[word[ends]] = self.ordinals[rank[ends]]
                on = ~over
                word, at, state, rank = word[on], at[on], state[on], rank[on]
                if not len(word):
                    break
            arc = self._arcs(state, data[at].astype(np.int64))
            on = arc >= 0
            arc, word, at = arc[on], word[on], at[on] + 1
            state, rank = self.targets[arc].astype(np.int64), rank[on] + self.outputs[arc]
        return out

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.packed)
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Transducer:
        return cls(**np.load(io.BytesIO(raw)))


def transducer(terms: Sequence[bytes], ordinals: Sequence[int]) -> Transducer:
    """The minimal acyclic transducer of distinct terms in byte order.

    The path of the last term is open; when the next term leaves it, the states below the fork get no more arcs and are
    replaced by equal ones that are known already.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def settle(final: bool, arcs: list) -> int:
        state = (final, tuple(arcs))
        if state not in known:
            known[state] = len(states)
            states.append(state)
        return known[state]

    path, last = [[False, []]], b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, arcs)))

    for term in terms:
        same = 0
        while same < min(len(term), len(last)) and term[same] == last[same]:
            same += 1
        close(same)
        path.extend([False, []] for _ in term[same:])
        path[-1][0], last = True, term
    close(0)
    root = settle(*path[0])

    below = np.zeros(len(states), np.int64)  # terms that end in or below a state; targets come before their sources
    arcs, targets, outputs = [], [], []
    number = np.arange(1, len(states) + 1)
    number[root] = 0
    for i, (final, out) in enumerate(states):
        passed = int(final)
        for byte, target in out:
            arcs.append(int(number[i]) << 8 | byte)
            targets.append(int(number[target]))
            outputs.append(passed)
            passed += int(below[target])
        below[i] = passed
    finals = np.zeros(len(states) + 1, bool)
    finals[number] = [final for final, _ in states]
    return Transducer(np.array(arcs, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32), finals, np.array(ordinals, np.int64))


# document frequencies


def _rows(counts: dict[tuple, Counter], names: Sequence[str]) -> pa.RecordBatch:
    """One row per group and term."""
    keys = [k for k, c in counts.items() for _ in range(len(c))]
    columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(len(names) - 2)]
    terms = pa.array([t for c in counts.values() for t in c], pa.binary()).cast(pa.string())
    numbers = pa.array([n for c in counts.values() for n in c.values()], pa.int64())
    return pa.RecordBatch.from_arrays([*columns, terms, numbers], names=list(names))


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, str], list[bytes]]]:
    for batch in batches:
        for piece in slices(batch):
            texts = pc.fill_null(piece.column("text"), "").cast(pa.large_binary())
            for lang, source, text in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), texts, strict=True):
                yield (lang, source), _TERM.findall(text.as_py().lower())


def _document_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, Counter] = defaultdict(Counter)
    held = 0
    for (lang, _), terms in _texts(batches):
        of = counts[(lang,)]
        held -= len(of)
        of.update(set(terms))
        held += len(of)
        if held > HELD:
            yield _rows(counts, ("lang", "term", "n"))
            counts.clear()
            held = 0
    if counts:
        yield _rows(counts, ("lang", "term", "n"))


def _group_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, Counter] = defaultdict(Counter)
    held = 0
    for group, terms in _texts(batches):
        of = counts[group]
        held -= len(of)
        of.update(terms)
        held += len(of)
        if held > HELD:
            yield _rows(counts, ("lang", "source", "term", "n"))
            counts.clear()
            held = 0
    if counts:
        yield _rows(counts, ("lang", "source", "term", "n"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """`lang, term, ordinal, v`: the kept terms of every language in byte order, and their number."""
    found = texts.select("lang", "source", "text").mapInArrow(_document_terms, "lang string, term string, n long")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    return materialize(places(kept.select("lang", "term"), "lang", ["term"], "ordinal", "v"))


# transducers


def _shard(term: Column, v: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.ceil(v / SHARD_TERMS))


def _build(rows: pa.Table) -> pa.Table:
    terms = rows["term"].cast(pa.binary()).to_pylist()
    ordinals = rows["ordinal"].to_pylist()
    order = sorted(range(len(terms)), key=ordinals.__getitem__)
    machine = transducer([terms[i] for i in order], [ordinals[i] for i in order])
    return pa.table({"lang": rows["lang"][:1], "shard": rows["shard"][:1], "machine": pa.array([machine.pack()], pa.binary())})


def transducers(kept: DataFrame) -> DataFrame:
    """`lang, shard, machine`: packed transducers of the kept terms."""
    dealt = kept.select("lang", _shard(F.col("term"), F.col("v")).alias("shard"), "term", "ordinal")
    return materialize(dealt.groupBy("lang", "shard").applyInArrow(_build, "lang string, shard long, machine binary"))


# recounting


class _Tally:
    """Counts per group and ordinal as sorted arrays."""

    def __init__(self):
        self.groups: dict[tuple, int] = {}
        self.keys, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, group: np.ndarray, ordinal: np.ndarray) -> None:
        keys, numbers = np.unique(group << 40 | ordinal, return_counts=True)
        merged, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.zeros(len(merged), np.int64)
        np.add.at(total, place, np.concatenate([self.numbers, numbers]))
        self.keys, self.numbers = merged, total

    def rows(self) -> pa.RecordBatch:
        names = list(self.groups)
        group = self.keys >> 40
        columns = [pa.array([n[i] for n in names], pa.string()).take(pa.array(group)) for i in (0, 1)]
        out = pa.RecordBatch.from_arrays([*columns, pa.array(self.keys & ((1 << 40) - 1)), pa.array(self.numbers)], names=["lang", "source", "ordinal", "n"])
        self.__init__()
        return out


def _streamed(packed):
    """Texts through all transducers of their language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines: dict[str, list[Transducer]] = defaultdict(list)
        for lang, raw in packed.value:
            machines[lang].append(Transducer.unpack(raw))
        tally = _Tally()
        for batch in batches:
            for piece in slices(batch):
                texts = lowered(texts_of(piece.column("text")))
                words = words_of(texts, _BETWEEN)
                langs, sources = piece.column("lang").to_pylist(), piece.column("source").to_pylist()
                group = np.array([tally.groups.setdefault(g, len(tally.groups)) for g in zip(langs, sources, strict=True)], np.int64)
                owner = words.owner
                for lang in set(langs) & set(machines):
                    own = np.array([x == lang for x in langs])[owner]
                    start, end, of = words.start[own], words.end[own], group[owner[own]]
                    for machine in machines[lang]:
                        ordinal = machine.ordinals_of(texts.data, start, end)
                        tally.add(of[ordinal >= 0], ordinal[ordinal >= 0])
                if len(tally.keys) > HELD:
                    yield tally.rows()
        if len(tally.keys):
            yield tally.rows()

    return run


def _looked_up(terms: pa.Table, shards: pa.Table) -> pa.Table:
    if not len(shards) or not len(terms):
        return pa.table({c: pa.array([], t) for c, t in (("lang", pa.string()), ("source", pa.string()), ("ordinal", pa.int64()), ("n", pa.int64()))})
    texts = texts_of(terms["term"].combine_chunks())
    ordinal = Transducer.unpack(shards["machine"][0].as_py()).ordinals_of(texts.data, texts.offsets[:-1], texts.offsets[1:])
    return terms.select(["lang", "source", "n"]).add_column(2, "ordinal", pa.array(ordinal)).filter(pa.array(ordinal >= 0))


def recount(texts: DataFrame, kept: DataFrame, machines: DataFrame) -> DataFrame:
    """`lang, source, ordinal, n`: occurrences of every kept term in every group that has it."""
    spark = texts.sparkSession
    texts = texts.select("lang", "source", "text")
    size = machines.agg(F.sum(F.length("machine"))).first()[0] or 0
    if size <= MOST_BYTES:
        packed = spark.sparkContext.broadcast([(r["lang"], bytes(r["machine"])) for r in machines.select("lang", "machine").collect()])
        found = texts.mapInArrow(_streamed(packed), "lang string, source string, ordinal long, n long")
    else:
        sizes = kept.groupBy("lang").agg(F.first("v").alias("v"))
        terms = texts.mapInArrow(_group_terms, "lang string, source string, term string, n long")
        summed = terms.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(sizes, "lang")
        dealt = summed.select("lang", _shard(F.col("term"), F.col("v")).alias("shard"), "source", "term", "n")
        found = (
            dealt.groupBy("lang", "shard").cogroup(machines.groupBy("lang", "shard"))
            .applyInArrow(_looked_up, "lang string, source string, ordinal long, n long")
        )
    return materialize(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))


# shares


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * v)), exact."""
    whole, part = (total + ADDED * v).cast("decimal(20,0)"), (n + ADDED).cast("decimal(20,0)")
    return 1 + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * part, whole)


def _ranked(rows: DataFrame, tie: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(order))


def _compared(source_block: int, term_block: int):
    def compare(rows: pa.Table) -> pa.Table:
        """Sums of |p - q| of the sources of two blocks over the terms of one; rows of ordinal -1 are the sources' base shares."""
        at, ordinal, p = (rows[c].to_numpy() for c in ("at", "ordinal", "p"))
        base = ordinal < 0
        order = np.argsort(at[base])
        sources, shares = at[base][order], p[base][order]
        first = int(rows["term_block"][0].as_py()) * term_block
        width = max(0, min(term_block, int(rows["v"][0].as_py()) - first))
        table = np.repeat(shares[:, None], width, axis=1)
        table[np.searchsorted(sources, at[~base]), ordinal[~base] - first] = p[~base]
        a, b = (int(rows[c][0].as_py()) for c in ("a", "b"))
        block = sources // source_block
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        one, other, value = [], [], []
        for i in left:
            js = right[right > i]
            one.append(np.full(len(js), sources[i]))
            other.append(sources[js])
            value.append(np.abs(table[js] - table[i]).sum(axis=1))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, other, value)]
        n = len(flat[0])
        return pa.table({"lang": pa.repeat(rows["lang"][0], n), "one": flat[0], "other": flat[1], "value": flat[2]})

    return compare


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """`lang, source, item, value` of every two sources of a language, both ways.

    groups: `lang, source, at, sources, v, p` (base share); shares: `lang, at, ordinal, p` of occurring terms.
    """
    last_block = F.floor((F.col("sources") - 1) / SOURCE_BLOCK)
    last_terms = F.greatest(F.floor((F.col("v") - 1) / TERM_BLOCK), F.lit(0))
    base = groups.select("lang", "at", F.lit(-1).cast("long").alias("ordinal"), "p", F.explode(F.sequence(F.lit(0).cast("long"), last_terms)).alias("term_block"))
    own = shares.select("lang", "at", "ordinal", "p", F.floor(F.col("ordinal") / TERM_BLOCK).alias("term_block"))
    sizes = groups.groupBy("lang").agg(F.max("sources").alias("sources"), F.max("v").alias("v"))
    rows = base.unionByName(own).join(sizes, "lang").withColumn("own", F.floor(F.col("at") / SOURCE_BLOCK))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    rows = rows.select("lang", "at", "ordinal", "p", "v", "term_block", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"))
    sums = rows.groupBy("lang", "term_block", "a", "b").applyInArrow(_compared(SOURCE_BLOCK, TERM_BLOCK), "lang string, one long, other long, value long")
    sums = materialize(sums.groupBy("lang", "one", "other").agg(F.sum("value").alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("one"), F.col("one").alias("other"), "value"))
    names = groups.select("lang", "at", "source")
    named = both.join(names.withColumnRenamed("at", "one"), ["lang", "one"])
    return named.join(names.withColumnsRenamed({"at": "other", "source": "item"}), ["lang", "other"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame) -> DataFrame:
    """`lang, source, part, item, value, rank`: how each source's terms differ from other sources (`pair`) and its language (`term`)."""
    names = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")}
    texts = docs.select(*names.values())
    kept = vocabulary(texts)
    counts = recount(texts, kept, transducers(kept))

    sizes = kept.groupBy("lang").agg(F.first("v").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(names["lang"], names["source"]).distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.fillna(0, ["total", "v"])
    each = Window.partitionBy("lang")
    groups = materialize(
        groups.withColumns({"at": F.row_number().over(each.orderBy("source")).cast("long") - 1, "sources": F.count("*").over(each), "whole": F.sum("total").over(each)})
    )
    shares = counts.join(groups.select("lang", "source", "at", "total", "v", "whole"), ["lang", "source"])
    shares = materialize(shares.withColumn("p", _share(F.col("n"), F.col("total"), F.col("v"))).drop("total"))

    based = groups.withColumn("p", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(1))
    pairs = _ranked(_pairs(based, shares.select("lang", "at", "ordinal", "p")), "item").withColumn("part", F.lit("pair"))

    over = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("all"))
    excess = shares.join(over, ["lang", "ordinal"]).withColumn("value", F.col("p") - _share(F.col("all"), F.col("whole"), F.col("v")))
    top = _ranked(excess.where("value > 0").select("lang", "source", "ordinal", "value"), "ordinal").where(F.col("rank") <= TOP_TERMS)
    named = top.join(kept.select("lang", "ordinal", F.col("term").alias("item")), ["lang", "ordinal"]).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(named.select(*columns))
