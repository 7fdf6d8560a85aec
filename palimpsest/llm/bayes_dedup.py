"""MinHash near-dedup with sequential Bayesian verification of banded candidates.

1. One pass over the texts gives every document the size and a 128-bit digest of its set of word shingles
   and a signature of `BANDS * ROWS` min-hashes. Documents with equal sets are one class from here on, so
   groups of copies cost one row each.
2. Classes sharing a band (a run of `ROWS` equal min-hashes) are candidates. A band's members are not
   paired with each other: first every class meets one pivot of its bands, then the pivots of the others,
   then pivots chosen anew; after every round, pairs whose ends are connected already leave. What stays in
   bands of several components is compared in full: all members against those outside the band's largest
   component, so no link is lost and a group of n near copies costs about n comparisons a round. Before
   that, members whose shingles found in other members are too few for any link leave: counting these is
   linear, and far variants of one text are not paired with each other.
3. A pair is compared sequentially: first 128 one-bit hashes inside the join, then batches of signature
   values. With m of n values equal and a uniform prior, the posterior of the similarity is Beta(m + 1,
   n - m + 1); a pair leaves as soon as the chance of reaching the threshold falls below `MISS`.
4. Survivors are verified exactly on their whole shingle sets, in integers.

A pair at the threshold misses every band with chance (1 - 0.75^6)^60 < 1e-5; all others miss less often.

Defined results: words are case-folded for A-Z only; fewer words than a shingle form one shingle; null,
empty and blank texts have no shingles and are linked with nothing; repeated rows and ties join the same
component; an empty table gives an empty result. A row without an id links nothing and is never dropped; its
component is the smallest id with the same shingles that has one, else null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize
from palimpsest.llm.components import components
from palimpsest.llm.sieve import maybe, sieve, without
from palimpsest.llm.words import gram_hashes, lowered, run_hashes, slices, texts_of, tidied, word_hashes, words_of

SHINGLE = 5
#: Percent of the union that must be shared.
PERCENT = 75
BANDS, ROWS = 60, 6
#: Chance at which a pair's posterior of reaching the threshold is given up.
MISS = 1e-6
BATCH = 40
#: Members of a block.
SIDE = 256

_rng = np.random.default_rng(20240229)
_TIMES = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)
_PLUS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    texts = lowered(texts_of(column))
    words = words_of(texts)
    hashes = word_hashes(texts, words)
    grams = gram_hashes(hashes, size)
    first = words.first.tolist()
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(run_hashes(hashes[a:b], np.array([0]), np.array([b - a])) if b > a else grams[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The low 16 bits of the min-hashes of non-empty sets, one row a set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    begin = np.cumsum(sizes) - sizes
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), BANDS * ROWS), np.uint16)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat(values * _TIMES[k] + _PLUS[k], begin)
        least ^= least >> np.uint32(16)  # the minimum itself is small: mix before cutting
        least *= np.uint32(0x7FEB352D)
        out[:, k] = least >> np.uint32(16)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, digest_a, digest_b, bits_a, bits_b, sig`: one row a document, in one pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(sizes)
                digest, bits = np.zeros((len(sets), 2), np.int64), np.zeros((len(sets), 2), np.int64)
                sig: list = [None] * len(sets)
                if len(full):
                    own = [sets[i] for i in full]
                    begin = np.cumsum(sizes[full]) - sizes[full]
                    flat = np.concatenate(own)
                    digest[full, 0] = np.add.reduceat(flat, begin).view(np.int64)
                    digest[full, 1] = np.add.reduceat((flat ^ (flat >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), begin).view(np.int64)
                    found = signatures(own)
                    bits[full] = np.packbits((found[:, :128] & 1).astype(np.uint8), axis=1).view(np.int64)
                    for i, row in zip(full.tolist(), found, strict=True):
                        sig[i] = row.tobytes()
                columns = [sizes, digest[:, 0], digest[:, 1], bits[:, 0], bits[:, 1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(sig, pa.binary())],
                    ["doc_id", "n_shingles", "digest_a", "digest_b", "bits_a", "bits_b", "sig"],
                )

    schema = "doc_id long, n_shingles long, digest_a long, digest_b long, bits_a long, bits_b long, sig binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), schema)


@lru_cache(maxsize=1024)
def least_equal(n: int, threshold: float, miss: float) -> int:
    """The smallest m for which P(p >= threshold | m of n equal, uniform prior) is at least `miss`.

    That posterior tail equals the chance of at most m successes in n + 1 trials at the threshold.
    """
    chance, tail = (1 - threshold) ** (n + 1), 0.0
    for m in range(n + 1):
        tail += chance
        if tail >= miss:
            return m
        chance *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
    return n


def _alike(prefix_a: str, prefix_b: str) -> Column:
    """Sizes that allow the threshold, and enough of 128 one-bit hashes equal (chance (1 + s) / 2 each)."""
    a, b = (lambda c: F.col(f"{prefix_a}.{c}")), (lambda c: F.col(f"{prefix_b}.{c}"))
    small, large = F.least(a("n"), b("n")), F.greatest(a("n"), b("n"))
    other = F.bit_count(a("bits_a").bitwiseXOR(b("bits_a"))) + F.bit_count(a("bits_b").bitwiseXOR(b("bits_b")))
    return (small * 100 >= large * PERCENT) & (128 - other >= least_equal(128, (1 + PERCENT / 100) / 2, MISS))


def bayes_prune(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The `a, b` pairs whose posterior never fell below `MISS` in any batch of signature values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BANDS * ROWS
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, width) for c in ("sa", "sb"))
            alive, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for begin in range(0, width, BATCH):
                end = min(begin + BATCH, width)
                equal[alive] += (left[alive, begin:end] == right[alive, begin:end]).sum(axis=1)
                alive = alive[equal[alive] >= least_equal(end, PERCENT / 100, MISS)]
            kept = batch.take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    with_a = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a")
    with_b = with_a.join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    return with_b.select("a", "b", "sa", "sb").mapInArrow(tidied(run), "a long, b long")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`doc_id, items` of the wanted documents; texts that surely are not wanted stay where they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                items = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), items], ["doc_id", "items"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    asked = maybe(chosen, F.col("doc_id"), sieve(wanted, "doc_id")).where("`~maybe`").select("doc_id", "text")
    return asked.mapInArrow(tidied(run), "doc_id long, items array<bigint>")


def exact_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("ia")), "a")
    with_b = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("ib")), "b")
    shared = F.size(F.array_intersect("ia", "ib")).cast("long")
    union = F.size("ia") + F.size("ib") - shared
    return with_b.where(shared * 100 >= union * PERCENT).select("a", "b")


def _pivots(members: DataFrame, turn: int) -> DataFrame:
    """One member of every band, another for every turn."""
    order = F.col("doc_id") if turn == 0 else F.xxhash64("doc_id", F.lit(turn))
    member = F.struct("doc_id", "n", "bits_a", "bits_b", "label")
    return members.groupBy("band").agg(F.min_by(member, order).alias("p"))


def _mixed(members: DataFrame) -> DataFrame:
    """Members of bands that hold several components."""
    mixed = members.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return materialize(members.join(mixed.select("band"), "band"))


def _able(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members with `shared`, the shingles they have in common with any other member, if these allow a link.

    A shingle of one member only is in no intersection. Variants of one text whose own edits exceed the
    threshold leave here, without being paired. Done twice, as fewer members share less.
    """
    members = members.withColumn("shared", F.col("n"))
    for _ in range(2):
        own = sets.join(members.select("doc_id").distinct(), "doc_id").select("doc_id", F.explode("items").alias("item"))
        alone = own.groupBy("item").agg(F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("doc_id")).where("texts = 1")
        private = alone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("private"))
        counted = members.drop("shared").join(private, "doc_id", "left")
        counted = counted.withColumn("shared", F.col("n") - F.coalesce("private", F.lit(0))).drop("private")
        members = _mixed(counted.where(F.col("shared") * 100 >= F.col("n") * PERCENT))
    return members


def _compare_blocks(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """`a, b`: pairs of different components that no bound excludes, each once.

    Members of a band meet those outside its largest component (`main`) in blocks of about `SIDE` by `SIDE`,
    compared with numpy: a row of the join is a pair of blocks, and only what survives becomes rows.
    """
    item = F.struct("doc_id", "label", "n", "shared", "sig")
    sizes = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("blocks"))
    dealt = members.join(sizes, "band").join(sigs, "doc_id")
    dealt = materialize(dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("blocks"))))
    block = lambda rows, name: rows.groupBy("place", "band", "main", "block").agg(F.collect_list(item).alias(name))
    left = block(dealt, "left")
    right = block(dealt.where("label <> main"), "right").select("band", "right")
    marks = [(end, least_equal(end, PERCENT / 100, MISS)) for end in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def sides(column: pa.ListArray) -> list[tuple[np.ndarray, ...]]:
        flat, at = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
        fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
        sig = np.frombuffer(b"".join(flat.field(4).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
        return [(*(f[i:j] for f in fields), sig[i:j]) for i, j in zip(at, at[1:], strict=False)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out_a, out_b = [], []
            context = zip(batch.column("place").to_pylist(), batch.column("main").to_pylist(), strict=True)
            for (place, main), one, other in zip(context, sides(batch.column("left")), sides(batch.column("right")), strict=True):
                ids, label, n, shared, sig = one
                for doc, own, size, common, values in zip(*other, strict=True):
                    fine = (label != own) & ((label == main) | (ids < doc))  # two outsiders meet twice
                    fine &= (np.minimum(n, size) * 100 >= np.maximum(n, size) * PERCENT)
                    fine &= np.minimum(shared, common) * (100 + PERCENT) >= PERCENT * (n + size)
                    rows = np.flatnonzero(fine)
                    equal = sig[rows] == values
                    first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)  # a pair counts in its first common band
                    rows, equal = rows[first == place], equal[first == place]
                    for begin, (end, least) in zip(range(0, BANDS * ROWS, BATCH), marks, strict=True):
                        so_far = equal[:, begin:end].sum(axis=1) + (so_far if begin else 0)
                        alive = so_far >= least
                        rows, equal, so_far = rows[alive], equal[alive], so_far[alive]
                    out_a.append(np.full(len(rows), doc))
                    out_b.append(ids[rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_a, out_b)], ["a", "b"])

    return left.join(right, "band").select("place", "main", "left", "right").mapInArrow(tidied(run), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, component_id`, one row a document: components of the exact similarity links."""
    sketched = materialize(sketches(docs))
    same = ("n_shingles", "digest_a", "digest_b")
    full = sketched.where("n_shingles > 0")
    classes = materialize(
        full.groupBy(*same).agg(
            F.min("doc_id").alias("doc_id"), F.min_by("sig", "doc_id").alias("sig"),
            F.min_by("bits_a", "doc_id").alias("bits_a"), F.min_by("bits_b", "doc_id").alias("bits_b"),
        )
    )
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)))
    banded = classes.select("doc_id", F.posexplode(keys).alias("place", "band"))
    crowded = banded.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("band")
    traits = classes.select("doc_id", F.col("n_shingles").alias("n"), "bits_a", "bits_b")
    members = materialize(banded.join(crowded, "band").join(traits, "doc_id"))
    sigs = classes.select("doc_id", "sig")
    sets = materialize(whole_sets(docs, members.select("doc_id").distinct()))

    def links_of(pairs: DataFrame, pruned: bool = False) -> DataFrame:
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return materialize(exact_links(ordered if pruned else bayes_prune(ordered, sigs), sets))

    def labelled(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return members.withColumn("label", F.col("doc_id"))
        known = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return known.withColumn("label", F.coalesce("label", "doc_id"))

    def to_pivots(frame: DataFrame, turn: int) -> DataFrame:
        met = frame.alias("m").join(_pivots(frame, turn), "band").alias("m")
        apart = (F.col("m.label") != F.col("m.p.label")) & _alike("m", "m.p")
        return met.where(apart).select(F.col("m.doc_id").alias("a"), F.col("m.p.doc_id").alias("b"))

    # one pivot a class: the one it shares most bands with
    often = to_pivots(labelled(None), 0).groupBy("a", "b").agg(F.count(F.lit(1)).alias("bands"))
    first = often.groupBy("a").agg(F.max_by("b", F.struct("bands", F.negative("b"))).alias("b"))
    links = links_of(first)
    labels = components(links)

    # all pivots, of two choices, for what is still apart
    now = materialize(labelled(labels))
    more = links_of(to_pivots(now, 0).union(to_pivots(now, 1)).union(to_pivots(now, 2)))
    labels = components(links.union(more))

    # bands that still hold several components: every member against those outside the largest one
    now = _able(_mixed(labelled(labels)), sets)
    shares = now.groupBy("band", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = shares.groupBy("band").agg(F.max_by("label", F.struct("size", F.negative("label"))).alias("main"))
    last = links_of(_compare_blocks(now.join(largest, "band"), sigs), pruned=True)
    labels = components(links.union(more).union(last))

    members_of = full.select("doc_id", *same).join(classes.select(*same, F.col("doc_id").alias("node")), [*same])
    placed = members_of.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
    alone = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are the smallest of their component, with all their columns."""
    found = materialize(near_duplicates(docs))
    dropped = found.where("doc_id <> component_id").select("doc_id")
    return without(docs, F.col("doc_id").cast("long"), dropped, "doc_id")
