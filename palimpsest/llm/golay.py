"""SimHash near-dedup: fuzzy hashing of fingerprint segments with the binary Golay code.

The (23, 12) Golay code is perfect: every 23-bit vector lies within 3 bits of one codeword, and the codeword's 12 data
bits are an index of the vector. Two vectors that differ in one bit may lie near different codewords, so a vector gets
the indices of all codewords its one-bit neighbours decode to: one index, or six for a vector at distance 3. The index
of any vector is then among those of each vector one bit away.

A 64-bit fingerprint is cut into three segments, each a shortened vector. Two errors over three segments leave one
segment without errors and another with one at most; taken cyclically, some segment is equal and its successor has one
error at most. A key is an exact segment with an index of the next one: every fingerprint is at home under its own
index and near under the others, three cycles each. Fingerprints at home meet those near, and the pairs are verified.

Keys of very many fingerprints are not paired. Their fingerprints list themselves and their one-bit neighbours;
fingerprints that list the same point differ in two bits at most, and any that do so share such a point, so linking all
of a point to its smallest loses no connection. A point has at most 65 of them.

Defined results: equal fingerprints are one class, folded before any key is made, so groups of copies cost one row;
null, empty and blank texts have the fingerprint zero and are linked like any other; fewer words than a shingle form
one shingle; very long texts are counted in parts; rows with a null id take part and get the smallest other id of their
component (null if it has none); repeated rows are rows of their own; extra columns take no part; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize
from palimpsest.llm.components import components
from palimpsest.llm.words import lowered, slices, texts_of, tidied, words_of

SHINGLE = 3
SEED = 42
#: Bits in which linked fingerprints differ at most; the keys below hold for two.
DISTANCE = 2
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a key that are paired; keys of more go by their one-bit neighbours.
BUCKET = 64
#: Shingles counted at once: their bits are summed as longs, 512 bytes a shingle.
PART = 16_384
#: Bytes of text laid out at once, which takes some 50 bytes of places for every byte.
LAID_BYTES = 250_000

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code.
GENERATOR = 0b110001110101


def _remainder(values: np.ndarray) -> np.ndarray:
    """Of 23-bit polynomials, modulo the generator."""
    out = values.astype(np.int64)
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of single bits, and the error pattern (three bits at most) of every syndrome."""
    bits = _remainder(1 << np.arange(23))
    errors = np.zeros(1 << 11, np.int64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                pattern = (1 << a) | (1 << b) | (1 << c)
                errors[np.bitwise_xor.reduce([bits[k] for k in range(23) if pattern >> k & 1])] = pattern
    return bits, errors


def indices(values: np.ndarray) -> np.ndarray:
    """The data bits of the nearest codewords."""
    _, errors = _tables()
    values = values.astype(np.int64)
    return (values ^ errors[_remainder(values)]) >> 11


def near_indices(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of indices: of the value itself first, then of its neighbours by one of `width` bits."""
    bits, errors = _tables()
    values = values.astype(np.int64)
    own = _remainder(values)
    out = [(values ^ errors[own]) >> 11]
    for b in range(width):
        out.append((values ^ (1 << b) ^ errors[own ^ bits[b]]) >> 11)
    return np.stack(out, axis=1)


def _hashes(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    pairs = zip(start.tolist(), end.tolist(), strict=True)
    return np.fromiter((digest(raw[a:b], SEED) for a, b in pairs), np.uint64, len(start))


def fingerprint(column: pa.Array) -> np.ndarray:
    """Unsigned fingerprints of texts: a bit is set if it is in over half of the shingles' hashes."""
    texts = lowered(texts_of(column))
    words = words_of(texts)
    length = words.end - words.start
    begin = np.cumsum(length + 1) - (length + 1)
    laid = np.full(int((length + 1).sum()), 0x20, np.uint8)
    place = np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)
    source = np.repeat(words.start, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    laid[place] = texts.data[source]
    raw = laid.tobytes()

    counts = words.counts
    shingles = np.where(counts > 0, np.maximum(counts - (SHINGLE - 1), 1), 0)
    owner = np.repeat(np.arange(len(counts)), shingles)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + words.first[:-1][owner]
    last = first + np.minimum(counts[owner], SHINGLE) - 1
    ends = begin + length
    totals = np.zeros((len(counts), 64), np.int64)
    for at in range(0, len(owner), PART):
        part = slice(at, at + PART)
        h = _hashes(raw, begin[first[part]], ends[last[part]])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        texts_here, runs = np.unique(owner[part], return_index=True)
        totals[texts_here] += np.add.reduceat(bits, runs, axis=0, dtype=np.int64)
    majority = 2 * totals > shingles[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """`doc_id, fingerprint` (as a signed long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, budget=LAID_BYTES):
                marks = fingerprint(piece.column("text")).view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(marks)], names=["doc_id", "fingerprint"])

    wanted = docs.select("doc_id", "text")
    return wanted.mapInArrow(tidied(run), wanted.select("doc_id").schema.add("fingerprint", "long"))


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("fingerprint").to_numpy().view(np.uint64)
        for cycle in range(3):
            (at, width), (after, size) = SEGMENTS[cycle], SEGMENTS[(cycle + 1) % 3]
            exact = (values >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)
            near = near_indices((values >> np.uint64(after)).astype(np.int64) & ((1 << size) - 1), size)
            home = near[:, :1]
            near = np.sort(near, axis=1)
            keep = np.ones(near.shape, bool)
            keep[:, 1:] = near[:, 1:] != near[:, :-1]
            row, _ = np.nonzero(keep)
            index = near[keep]
            key = (np.int64(cycle) << np.int64(40)) | (exact[row] << 12) | index
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[row].view(np.int64)), pa.array(key), pa.array(index == home[row, 0])], names=["fingerprint", "key", "home"]
            )


def links(classes: DataFrame) -> DataFrame:
    """`a, b` links that connect all `fingerprint`s (distinct longs) within two bits of each other."""
    keyed = materialize(classes.select("fingerprint").mapInArrow(tidied(_keys), "fingerprint long, key long, home boolean"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes"))
    shared = materialize(sizes.where((F.col("rows") > 1) & (F.col("homes") > 0)).select("key", (F.col("rows") > BUCKET).alias("hot")))
    keyed = materialize(keyed.join(shared, "key"))

    paired = keyed.where("not hot")
    home = paired.where("home").select("key", F.col("fingerprint").alias("a"))
    other = paired.select("key", F.col("fingerprint").alias("b"))
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = home.join(other, "key").where((F.col("a") < F.col("b")) & (differing <= DISTANCE)).select("a", "b")

    crowded = keyed.where("hot").select("fingerprint").distinct()
    one_bit = F.array(F.col("fingerprint"), *[F.col("fingerprint").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(b))) for b in range(64)])
    points = crowded.select("fingerprint", F.explode(one_bit).alias("point"))
    # at most the 65 fingerprints around it list a point
    listed = points.groupBy("point").agg(F.array_sort(F.collect_list("fingerprint")).alias("all")).where(F.size("all") > 1)
    stars = listed.select(F.element_at("all", 1).alias("a"), F.explode(F.slice("all", 2, 65)).alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, fingerprint` (16 hex digits) and `component_id`, the smallest id reachable over links, of every row."""
    marked = materialize(fingerprints(docs))
    classes = materialize(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    state = components(links(classes)).withColumnRenamed("node", "fingerprint")
    joined = materialize(classes.join(state, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint")))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    named = joined.select("fingerprint", "label").join(least, "label").select("fingerprint", "component_id")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return marked.join(named, "fingerprint").select("doc_id", hexed, "component_id")
