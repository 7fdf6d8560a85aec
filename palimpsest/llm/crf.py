"""Word languages of code-switched text by a linear-chain conditional random field.

Every word has features of its letters (as bytes, in lower case): runs of two to five bytes with marks at both ends (so
affixes are among them) and the word itself (a lexicon). Each is hashed to a row of one weight table with a
column per language. Transitions between the languages of neighbouring words are learned with the weights:
training sequences are cut from labelled documents of several languages, so they switch.

The forward-backward pass is exact for texts of any length and runs over all words of a slice at once: texts
are cut into blocks, every block gets its matrix of path weights, the matrices are chained within each
text, and the pass inside the blocks starts from the chained states.

A document's language is the label of the largest mean marginal over its words with letters.

Training uses at most `TRAIN_ROWS` labelled documents (one a language if there are more languages), dealt to the
languages in turn, of smallest id hash within each. Documents of at most `TRAIN_CHARS` characters come first, whole; a
language that has too few of them adds the beginnings of longer ones. Ids are picked first; only the picked texts reach
the driver.

Defined results: a text that is null or has no letter is `und` with score 0; ties go to the smaller label;
without training rows every text is `und`; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize
from palimpsest.llm.words import Texts, Words, lowered, mixed, slices, texts_of, word_hashes, words_of

TRAIN_ROWS = 400
TRAIN_CHARS = 12_000
TABLE_BITS = 17
ORDERS = (2, 3, 4, 5)
#: Words of a training sequence, and of a block.
LENGTH, BLOCK = 64, 128
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] = True


def word_features(texts: Texts, words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the features of the chosen words (lower-cased texts), and where each word's begin."""
    size = words.end[chosen] - words.start[chosen] + 2  # with a mark at either end
    at = np.cumsum(size) - size
    source = np.repeat(words.start[chosen] - at - 1, size) + np.arange(size.sum())
    marked = texts.data[np.clip(source, 0, max(len(texts.data) - 1, 0))].astype(np.uint64)
    marked[at], marked[at + size - 1] = 256, 257
    owner = np.repeat(np.arange(len(chosen)), size)
    spoken = ((marked >= 0x61) & (marked <= 0x7A)) | (marked >= 0x80)  # digits and marks say nothing about a language
    marked, owner = marked[spoken], owner[spoken]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    whole = np.add.reduceat(mixed(marked + (place.astype(np.uint64) << np.uint64(9))), np.searchsorted(owner, np.arange(len(chosen))))
    rows, owners = [mixed(whole)], [np.arange(len(chosen))]
    for order in ORDERS:
        if len(marked) < order:
            continue
        value = np.full(len(marked) - order + 1, order, np.uint64)
        for k in range(order):
            value = (value << np.uint64(9)) | marked[k : len(marked) - order + 1 + k]
        inner = owner[: len(value)] == owner[order - 1 :]
        rows.append(mixed(value[inner]))
        owners.append(owner[: len(value)][inner])
    owner = np.concatenate(owners)
    order = owner.argsort(kind="stable")
    rows = (np.concatenate(rows) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)[order]
    return rows, np.searchsorted(owner[order], np.arange(len(chosen)))


class Field:
    """Languages, the weight table (rows x languages) and the log transition weights."""

    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.weights, self.moves = labels, weights, moves

    def emissions(self, texts: Texts, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Log weights of every word for every language; each distinct word is scored once."""
        _, seen, back = np.unique(hashes, return_index=True, return_inverse=True)
        rows, begin = word_features(texts, words, seen)
        return np.add.reduceat(self.weights[rows], begin, axis=0)[back]


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Chance of every language at every word, by forward-backward over all texts at once."""
    return messages(scores, first, moves, False)[0]


def slope_of_moves(gold: np.ndarray, ahead: np.ndarray, behind: np.ndarray, weight: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Gradient of the log likelihood in the transitions: moves of the gold languages less the expected ones.

    A text begins with a move from any language, as `messages` takes it.
    """
    k = len(moves)
    step = np.exp(moves - moves.max())
    inner = np.ones(len(gold), dtype=bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    joint = ahead[at - 1, :, None] * step[None] * (weight[at] * behind[at])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    begin = first[:-1]
    chance = ahead[begin] * behind[begin]
    chance /= chance.sum(axis=1, keepdims=True)
    pairs = np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k)
    return pairs - joint.sum(axis=0) + step / step.sum(axis=0) * (np.eye(k)[gold[begin]] - chance).sum(axis=0)


def messages(
    scores: np.ndarray, first: np.ndarray, moves: np.ndarray, apart: bool = True
) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Forward and backward messages (each up to a factor a word) and weights of all words.

    If they need not be apart, their product (the chances) takes the place of the first, and None that of the second.
    """
    n, k = scores.shape
    if not n:
        return scores, scores if apart else None, scores
    weight = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    step = np.exp(moves - moves.max())
    counts = np.diff(first)
    blocks = -(-counts // BLOCK)
    text = np.repeat(np.arange(len(counts)), blocks)
    place = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = first[text] + BLOCK * place
    size = np.minimum(BLOCK, first[text + 1] - start)
    order = np.argsort(-size, kind="stable")  # the longest first: those still open are a prefix
    begin, open_at = start[order], np.searchsorted(-size[order], -np.arange(BLOCK), "left")
    # path weights of whole blocks
    paths = np.broadcast_to(np.eye(k), (len(text), k, k)).copy()
    for t in range(BLOCK):
        m = open_at[t]
        if not m:
            break
        paths[:m] = (paths[:m].reshape(-1, k) @ step).reshape(m, k, k) * weight[begin[:m] + t][:, None, :]
        paths[:m] /= paths[:m].max(axis=(1, 2), keepdims=True)
    rank = np.empty(len(text), np.int64)
    rank[order] = np.arange(len(text))
    head = np.cumsum(blocks) - blocks
    ahead, behind = np.full((len(text), k), 1.0 / k), np.ones((len(text), k))
    for j in range(1, int(blocks.max(initial=0))):
        own = np.flatnonzero(blocks > j)
        before, here = rank[head[own] + j - 1], rank[head[own] + j]
        state = np.einsum("nk,nkl->nl", ahead[before], paths[before])
        ahead[here] = state / state.sum(axis=1, keepdims=True)
        back, last = rank[head[own] + blocks[own] - j - 1], rank[head[own] + blocks[own] - j]
        state = np.einsum("nkl,nl->nk", paths[last], behind[last])
        behind[back] = state / state.sum(axis=1, keepdims=True)
    # inside the blocks
    out = np.empty_like(weight)
    back = np.empty_like(weight) if apart else None
    state = ahead
    for t in range(BLOCK):
        m = open_at[t]
        if not m:
            break
        state = (state[:m] @ step) * weight[begin[:m] + t]
        state /= state.sum(axis=1, keepdims=True)
        out[begin[:m] + t] = state
    state = behind.copy()
    for t in range(BLOCK - 1, -1, -1):
        m = open_at[t]
        if m:
            if back is None:
                out[begin[:m] + t] *= state[:m]
            else:
                back[begin[:m] + t] = state[:m]
            state[:m] = (weight[begin[:m] + t] * state[:m]) @ step.T
            state[:m] /= state[:m].sum(axis=1, keepdims=True)
    return (out if apart else out / out.sum(axis=1, keepdims=True)), back, weight


def fit(texts: list[str], langs: list[str], rounds: int = 20, ridge: float = 1e-6) -> Field:
    """Maximise the likelihood of labelled sequences by adaptive gradient steps over all of them."""
    labels = sorted(set(langs))
    k = len(labels)
    if not k:
        return Field([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros((0, 0)))
    laid = lowered(texts_of(pa.array(texts, pa.string())))
    words = words_of(laid)
    hashes = word_hashes(laid, words)
    _, seen, back = np.unique(hashes, return_index=True, return_inverse=True)
    label = np.repeat([labels.index(x) for x in langs], words.counts)
    # stretches of 6 to 45 words, in random order, laid end to end: sequences switch at their borders
    rng = np.random.default_rng(12)
    cuts = []
    for a, b in zip(words.first, words.first[1:], strict=False):
        at = a
        while at < b:
            end = min(b, at + int(rng.integers(6, 46)))
            cuts.append((at, end))
            at = end
    order = np.concatenate([np.arange(*cuts[i]) for i in rng.permutation(len(cuts))] or [np.zeros(0, np.int64)])
    whole = len(order) // LENGTH * LENGTH or len(order)
    order, width = order[:whole], min(LENGTH, whole)
    if not whole:
        return Field(labels, np.zeros((1 << TABLE_BITS, k), np.float32), np.zeros((k, k)))
    word, gold = back[order], label[order]
    rows, begin = word_features(laid, words, seen)
    owner = np.repeat(np.arange(len(seen)), np.diff(np.append(begin, len(rows))))
    weights, moves = np.zeros((1 << TABLE_BITS, k)), np.zeros((k, k))
    spent_w, spent_m = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    bounds = np.arange(0, whole + 1, width)
    gold_at = np.eye(k)[gold]
    for _ in range(rounds):
        scores = np.add.reduceat(weights[rows], begin, axis=0)[word]
        ahead, behind, weight = messages(scores, bounds, moves)
        chance = ahead * behind
        chance /= chance.sum(axis=1, keepdims=True)
        miss = gold_at - chance
        by_word = np.column_stack([np.bincount(word, miss[:, j], minlength=len(seen)) for j in range(k)])
        slope = np.column_stack([np.bincount(rows, by_word[owner, j], minlength=len(weights)) for j in range(k)]) - ridge * whole * weights
        slope_m = slope_of_moves(gold, ahead, behind, weight, bounds, moves)
        spent_w += (slope / whole) ** 2 * 1e6
        spent_m += (slope_m / whole) ** 2 * 1e2
        weights += 0.6 * (slope / whole) * 1e3 / np.sqrt(spent_w)
        moves = np.clip(moves + 0.3 * (slope_m / whole) * 10 / np.sqrt(spent_m), -6, 6)
    return Field(labels, weights.astype(np.float32), moves)


def train(docs: DataFrame, folds: int = 4, held: int = 2, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Field:
    """Fit on documents outside the held-out fold whose language is known."""
    found = sample(docs, folds, held, rows, chars)
    return fit([text for text, _ in found], [lang for _, lang in found])


def shares(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Rows of every language: dealt in turn while it has more, at least one each."""
    out, left = {}, rows
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        out[lang] = min(n, max(1, left // (len(counts) - i)))
        left -= out[lang]
    return out


def sample(docs: DataFrame, folds: int, held: int, rows: int, chars: int) -> list[tuple[str, str]]:
    """Texts and languages of the training documents; rows of one id, language and length class count once."""
    spark = docs.sparkSession
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    fine = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder != held) & (F.length("text") > 0)
    known = docs.where(fine).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", (F.length("text") > chars).alias("long"), "text")
    keys = materialize(known.select("doc_id", "lang", "long").distinct())
    counts = {(r["lang"], r["long"]): r["count"] for r in keys.groupBy("lang", "long").count().collect()}
    per_lang: dict[str, int] = {}
    for (lang, _), n in counts.items():
        per_lang[lang] = per_lang.get(lang, 0) + n
    wanted, most = {}, []
    for lang, n in shares(per_lang, rows).items():
        short = min(n, counts.get((lang, False), 0))
        for long, need in ((False, short), (True, n - short)):
            if need:
                wanted[lang, long] = need
                # so many hashes lie below the bound that those needed are among them
                part = (2 * need + 100) / counts[lang, long]
                most.append((lang, long, (1 << 63) - 1 if part >= 1 else int(part * (1 << 64)) - (1 << 63)))
    if not wanted:
        return []
    bounds = spark.createDataFrame(most, "lang string, long boolean, most long")
    place = F.xxhash64("doc_id").alias("place")
    near = keys.join(F.broadcast(bounds), ["lang", "long"]).select("doc_id", "lang", "long", "most", place).where("place <= most")
    by_group: dict[tuple[str, bool], list[tuple[int, int]]] = {}
    for r in near.collect():
        by_group.setdefault((r["lang"], r["long"]), []).append((r["place"], r["doc_id"]))
    picked = [(i, lang, long) for (lang, long), n in wanted.items() for _, i in sorted(by_group[lang, long])[:n]]
    chosen = spark.createDataFrame(picked, "doc_id long, lang string, long boolean")
    texts = known.join(F.broadcast(chosen), ["doc_id", "lang", "long"]).select("doc_id", "lang", "long", F.substring("text", 1, chars).alias("text"))
    found = texts.groupBy("doc_id", "lang", "long").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "long").collect()
    # the last word of a beginning may be cut
    whole = lambda r: (r["text"].rsplit(maxsplit=1) or [""])[0] if r["long"] else r["text"]
    return [(whole(r), r["lang"]) for r in found]


def _label_slice(part: pa.RecordBatch, field: Field) -> pa.RecordBatch:
    texts = lowered(texts_of(part.column("text")))
    words = words_of(texts)
    n, k = len(texts), len(field.labels)
    letters = np.concatenate(([0], np.cumsum(_LETTER[texts.data])))
    speaks = (letters[words.end] - letters[words.start]) > 0
    chance = np.zeros((0, k))
    if k and len(words.start):
        hashes = word_hashes(texts, words)
        chance = marginals(field.emissions(texts, words, hashes).astype(float), words.first, field.moves)
    heard = np.bincount(words.owner, speaks, minlength=n)
    share = np.column_stack([np.bincount(words.owner, chance[:, j] * speaks, minlength=n) for j in range(k)]) if len(chance) else np.zeros((n, k))
    share = share / np.maximum(heard, 1)[:, None]
    best = share.argmax(axis=1) if k else np.zeros(n, int)
    raw = part.column("text").to_pylist()
    known = np.array([bool(h) and k > 0 and (a > 0 or any(map(str.isalpha, t))) for h, a, t in zip(heard, _ascii(texts), raw, strict=True)])
    word_best = chance.argmax(axis=1) if len(chance) else np.zeros(0, int)
    fresh = np.ones(len(word_best), dtype=bool)
    fresh[1:] = word_best[1:] != word_best[:-1]
    if len(chance):
        fresh[words.first[:-1][words.counts > 0]] = True
    begin = np.flatnonzero(fresh)
    held = np.searchsorted(begin, words.first)
    end = np.append(begin[1:], len(word_best))
    spans = []
    for i in range(n):
        a, b = held[i], held[i + 1]
        at = words.first[i]
        rows = zip((begin[a:b] - at).tolist(), (end[a:b] - at).tolist(), word_best[begin[a:b]].tolist(), strict=True)
        spans.append([{"start": x, "end": y, "lang": field.labels[z]} for x, y, z in rows] if known[i] else [])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            pa.array([field.labels[b] if ok else "und" for b, ok in zip(best.tolist(), known, strict=True)], pa.string()),
            pa.array(np.where(known, share.max(axis=1) if k else 0.0, 0.0), pa.float64()),
            pa.array(spans, kind),
        ],
        ["doc_id", "lang_pred", "score", "spans"],
    )


def _ascii(texts: Texts) -> np.ndarray:
    """ASCII letters of every (lower-cased) text."""
    total = np.concatenate(([0], np.cumsum((texts.data >= 0x61) & (texts.data <= 0x7A))))
    return total[texts.offsets[1:]] - total[texts.offsets[:-1]]


def label(docs: DataFrame, field: Field) -> DataFrame:
    """`doc_id, lang_pred, score, spans`: the language of every whole text and the runs of words it was read from."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _label_slice(part, field)

    schema = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
