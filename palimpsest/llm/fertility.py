"""Tokeniser fertility: how public vocabularies cut a text, with rejection bands per language or script.

Every distinct word of a slice is encoded once with two public vocabularies: a byte-level BPE and a piece
BPE with byte fallback. A document has three measures over its words:

* characters (letters, digits and everything beyond ASCII) per token of both vocabularies: low where words
  are shouted, garbled or full of symbols;
* the share of byte-fallback tokens among the pieces;
* the entropy of its tokens in bits, relative to that of min(tokens, 256) equally frequent ones: low where a
  text repeats itself.

A document is kept if its base counts pass and every measure lies in the band of its language (the `lang`
column where it names a known band) or else of the script most of its letters belong to.

Defined results: a null text or one without words has no words, fails the base rule and is not kept; its
measures are null. Texts of any length are measured whole; repeated rows are judged alike; a null or
unknown language falls back to the script's band.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bpe import Codec, Pool, codec
from palimpsest.llm.words import Texts, Words, gram_hashes, slices, texts_of, word_hashes, words_of

#: Words of a generation: a process remembers the last two, in some 60 bytes each.
REMEMBERED = 300_000
#: Words learnt at once: the objects and tables of their pieces are in memory together.
LEARNT = 50_000
LEAST_WORDS = 50
MOST_REPEATED = 50

#: Bands: (characters per byte-level token, characters per piece token, byte share, relative entropy), each low and high.
BANDS: dict[str, tuple[tuple[float, float], ...]] = {
    "en": ((1.72, 6.5), (1.75, 6.5), (0.0, 0.05), (0.70, 1.75)),
    "de": ((1.70, 6.5), (1.82, 6.5), (0.0, 0.05), (0.70, 1.75)),
    "fr": ((1.58, 6.5), (1.64, 6.5), (0.0, 0.05), (0.70, 1.75)),
    "es": ((1.50, 6.5), (1.62, 6.5), (0.0, 0.05), (0.70, 1.75)),
    "latin": ((1.30, 7.0), (1.40, 7.0), (0.0, 0.10), (0.60, 1.75)),
    "greek": ((0.40, 4.0), (0.70, 5.0), (0.0, 0.30), (0.50, 1.75)),
    "cyrillic": ((0.40, 4.0), (1.10, 6.0), (0.0, 0.10), (0.55, 1.75)),
    "hebrew_arabic": ((0.40, 4.0), (0.50, 4.0), (0.0, 0.50), (0.45, 1.75)),
    "indic": ((0.15, 3.0), (0.15, 3.0), (0.0, 0.95), (0.35, 1.75)),
    "cjk": ((0.20, 3.0), (0.25, 3.0), (0.0, 0.80), (0.40, 1.75)),
    "other": ((0.15, 7.0), (0.15, 7.0), (0.0, 1.0), (0.40, 1.75)),
}
#: First bytes of a character, by script.
_SCRIPT = np.full(256, -1, dtype=np.int8)
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew_arabic", "indic", "cjk", "other")
_SCRIPT[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = 0
_SCRIPT[[0xCD, 0xCE, 0xCF]] = 1
_SCRIPT[range(0xD0, 0xD4)] = 2
_SCRIPT[range(0xD6, 0xDE)] = 3
_SCRIPT[[0xE0]] = 4
_SCRIPT[[0xE3, *range(0xE4, 0xEE)]] = 5
_SCRIPT[[0xDE, 0xDF, 0xE1, 0xE2, *range(0xEE, 0xF5)]] = 6

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_FEED = np.arange(256) == 0x0A
#: Bytes that begin a character which is a letter, a digit or beyond ASCII.
_TOLD = np.zeros(256, dtype=bool)
_TOLD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] = True


def counted(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def _groups(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by (owner, hash, place), the start of every group in it, and the group's sizes."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    begin = np.flatnonzero(fresh)
    return order, begin, np.diff(np.append(begin, len(h)))


def base_counts(texts: Texts, words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    data, at, n = texts.data, texts.offsets, len(texts)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = heads[words.end] - heads[words.start]

    lines = words_of(texts, _FEED)
    held = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    owner, line = lines.owner[held], word_hashes(texts, lines)[held]
    order, begin, _ = _groups(line, owner)
    repeated = np.ones(len(line), dtype=bool)
    repeated[begin] = False
    dup_lines = np.bincount(owner[order][repeated], minlength=n)

    owner = words.owner
    inside = np.flatnonzero(owner[2:] == owner[:-2])
    order, begin, size = _groups(gram_hashes(hashes, 3)[inside], owner[inside])
    twice = inside[order[np.repeat(size > 1, size)]]
    covered = np.zeros(len(hashes), dtype=bool)
    for shift in range(3):
        covered[twice + shift] = True
    return {
        "n_words": words.counts, "word_chars": counted(chars, words.first), "n_symbols": counted(_SYMBOL[data], at),
        "n_dup_lines": dup_lines, "n_repeat_words": counted(covered, words.first),
    }


class Learnt:
    """Encoded words in flat arrays, found by their hash: the number of byte-level tokens and the piece ids of each."""

    def __init__(self):
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.by_byte, self.ids = np.zeros(0, np.int64), Pool(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word; -1 where it is not known."""
        if not len(self):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        return np.where(self.hashes[at] == hashes, self.place[at], -1)

    def add(self, hashes: np.ndarray, by_byte: np.ndarray, ids: Pool) -> None:
        """Words that are not known yet; numbers of known ones stay."""
        place = np.concatenate((self.place, len(self) + np.arange(len(hashes))))
        hashes = np.concatenate((self.hashes, hashes))
        order = hashes.argsort(kind="stable")
        self.hashes, self.place = hashes[order], place[order]
        self.by_byte, self.ids = np.concatenate((self.by_byte, by_byte)), self.ids.plus(ids)


_pieces: dict[str, tuple] = {}


def piece_model(path: str):
    """The piece vocabulary, which of its ids are bytes, and the words encoded so far in this process."""
    if path not in _pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _pieces[path] = model, np.array([model.is_byte(i) for i in range(model.get_piece_size())]), [Learnt(), Learnt()]
    return _pieces[path]


#: White space that may stand in a word.
_ODD_SPACE = regex.compile(r"[^\S ]")


def _byte_tokens(words: list[str], byte_level: Codec) -> np.ndarray:
    """How many byte-level tokens every word has, a space before it; all words are parted in one pass of the pattern."""
    joined = " " + " ".join(words)
    if _ODD_SPACE.search(joined):  # might run from word to word
        cut = [byte_level.piece.findall(" " + w) for w in words]
        parts, number = [p for own in cut for p in own], np.fromiter(map(len, cut), np.int64, len(cut))
        first = np.cumsum(number) - number
    else:  # the space before a word begins a piece
        parts = byte_level.piece.findall(joined)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        long = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.searchsorted(np.cumsum(size) - size, np.cumsum(long) - long)
    place = {p: i for i, p in enumerate(dict.fromkeys(parts))}
    sizes = np.array(byte_level.count_pieces([p.encode() for p in place]), np.int64)
    each = sizes[np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))]
    return np.add.reduceat(each, first)


def _learn(new: list[bytes], byte_level: Codec, model) -> tuple[np.ndarray, Pool]:
    """Encode new words: the number of byte-level tokens and the piece ids of each."""
    words = b" ".join(new).decode().split(" ")  # a word holds no space
    ids = model.encode(words, num_threads=1)
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, size.sum())
    return _byte_tokens(words, byte_level), Pool(flat, np.cumsum(size) - size, size)


def measures(texts: Texts, words: Words, hashes: np.ndarray, byte_level: Codec, pieces) -> np.ndarray:
    """Characters per token (byte-level, pieces), byte share and relative entropy of every text (NaN without words)."""
    n = len(texts)
    out = np.full((n, 4), np.nan)
    if not len(hashes):
        return out
    raw, chars = texts.data.tobytes(), counted(_TOLD[texts.data], texts.offsets)
    distinct, seen, back = np.unique(hashes, return_index=True, return_inverse=True)
    model, is_byte, memory = pieces
    if len(memory[0]) > REMEMBERED:
        memory[:] = Learnt(), memory[0]
    known, older = memory
    missing = np.flatnonzero(known.find(distinct) < 0)
    at = older.find(distinct[missing])
    old, again, missing = at[at >= 0], missing[at >= 0], missing[at < 0]
    known.add(distinct[again], older.by_byte[old], older.ids.take(old))
    for a in range(0, len(missing), LEARNT):
        new = missing[a : a + LEARNT]
        places = zip(words.start[seen[new]].tolist(), words.end[seen[new]].tolist(), strict=True)
        known.add(distinct[new], *_learn([raw[i:j] for i, j in places], byte_level, model))
    number = known.find(distinct)
    by_byte, found = known.by_byte[number], known.ids.take(number)
    ids, size = found.data.astype(np.int64), found.size
    bytes_in = np.concatenate(([0], np.cumsum(is_byte[ids])))
    end = np.cumsum(size)
    fallback = bytes_in[end] - bytes_in[end - size]

    tokens = counted(size[back], words.first)
    full = words.counts > 0
    out[full, 0] = chars[full] / np.maximum(counted(by_byte[back], words.first)[full], 1)
    out[full, 1] = chars[full] / np.maximum(tokens[full], 1)
    out[full, 2] = counted(fallback[back], words.first)[full] / np.maximum(tokens[full], 1)
    # tokens of all words, keyed by text: how often each occurs there
    taken = size[back]
    to = np.cumsum(taken)
    flat = ids[np.repeat((end - size)[back] - (to - taken), taken) + np.arange(to[-1])]
    key = np.sort(np.repeat(np.arange(n), tokens) << 17 | flat)
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    often = np.diff(np.append(begin, len(key)))
    owner = key[begin] >> 17
    total = np.maximum(tokens, 1)
    entropy = np.log2(total) - np.bincount(owner, often * np.log2(often), minlength=n) / total
    out[full, 3] = (entropy / np.maximum(np.log2(np.minimum(total, 256)), 1e-9))[full]
    out[full & (tokens < 2), 3] = 1.0
    return out


def scripts(texts: Texts) -> np.ndarray:
    """The script of most letters of every text (place in `SCRIPTS`; the last where there are none)."""
    n, kinds = len(texts), len(SCRIPTS) + 1
    place = np.repeat(np.arange(1, n * kinds + 1, kinds), np.diff(texts.offsets))
    place += _SCRIPT[texts.data]
    share = np.bincount(place, minlength=n * kinds).reshape(n, kinds)[:, 1:]
    return np.where(share.any(axis=1), share.argmax(axis=1), len(SCRIPTS) - 1)


NAMES = ("chars_per_token", "chars_per_piece", "byte_share", "relative_entropy")


def judge(docs: DataFrame, byte_level: str, pieces: str, bands: dict | None = None) -> DataFrame:
    """Base counts, measures, band and verdict of every document. Both vocabularies are paths executors can open."""
    limits = {name: np.array(b) for name, b in (BANDS if bands is None else bands).items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = codec(byte_level), piece_model(pieces)
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part.column("text"))
                words = words_of(texts)
                hashes = word_hashes(texts, words)
                base = base_counts(texts, words, hashes)
                found = measures(texts, words, hashes, known, model)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                script = scripts(texts)
                band = [lang if lang in limits else SCRIPTS[s] for lang, s in zip(part.column("lang").to_pylist(), script, strict=True)]
                edge = np.array([limits.get(b, limits["other"]) for b in band]).reshape(len(band), len(NAMES), 2)
                within = ((found >= edge[:, :, 0]) & (found <= edge[:, :, 1])).all(axis=1)
                columns = [part.column("doc_id"), *(pa.array(v, pa.int64()) for v in base.values())]
                columns += [pa.array(failed), pa.array(~failed & within), pa.array(band, pa.string())]
                columns += [pa.array(found[:, k], pa.float64(), from_pandas=True) for k in range(len(NAMES))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *base, "base_failed", "kept", "band", *NAMES])
        known.forget()
        model[2][:] = Learnt(), Learnt()

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, band string, " + ", ".join(f"{n} double" for n in NAMES)
    )
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    return chosen.mapInArrow(run, schema)
