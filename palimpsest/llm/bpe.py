"""BPE encoding and decoding: greedy proposals, pair checks, exact merging of what fails.

The pieces of a text (the vocabulary's own pre-tokenizer pattern) are encoded once per distinct piece
and task. For a set of new pieces:

1. *speculate*: greedy longest match proposes tokens;
2. *verify*: a sequence is what merging gives exactly when every token is the merge result of its own
   bytes and every adjacent pair of tokens survives merging of the two alone. The pairs of all
   proposals are reduced to distinct ones, looked up in a table of pair verdicts, and the verdicts
   are folded back per piece with numpy;
3. *merge*: only pieces with a failing pair go through exact merging by rank.

Decoding maps ids to the bytes of their tokens and joins them. Special tokens that stand in a text are
taken as such, as the tokenizers library does by default.

Defined results: a null or empty text has no tokens; a text of any length is encoded whole; repeated
rows give repeated results; extra columns are ignored or carried, as the caller selects.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.words import Texts, Words, give_back, slices, texts_of, tidied, word_hashes

#: Distinct stretches of a generation: a process remembers the last two (the results do not depend on it).
REMEMBERED = 150_000

#: Stretches learnt at once: the objects and tables of their pieces are in memory together.
LEARNT = 12_000

#: The pattern of the byte-level pre-tokenizer (a fixed value: results depend on it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: First bytes after which a stretch may begin: no white space, and no lead of a character that is.
_SOLID = ~_WHITE
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def _safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the pattern begins a piece whatever surrounds them.

    A space before a non-space opens a piece; a line feed between an ASCII non-space and a non-space is one.
    Every text begins a stretch too.
    """
    begins = offsets[:-1][np.diff(offsets) > 0]
    solid_next = np.zeros(len(data), dtype=bool)
    solid_next[:-1] = _SOLID[data[1:]]
    solid_next[offsets[1:][np.diff(offsets) > 0] - 1] = False
    feed = data == 0x0A
    opens = (data == 0x20) & solid_next
    behind = np.zeros(len(data), dtype=bool)
    behind[1:] = (~_WHITE[data[:-1]]) & (data[:-1] < 0x80)
    behind[begins] = False
    alone = feed & solid_next
    cuts = opens | (alone & behind)
    cuts[1:] |= alone[:-1]
    cuts[begins] = True
    return np.flatnonzero(cuts)


@dataclass
class Pool:
    """Byte strings end to end: `data[start[i]:start[i] + size[i]]` is string i."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, values: list[bytes]) -> Pool:
        size = np.fromiter(map(len, values), np.int64, len(values))
        return cls(np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size, size)

    def plus(self, other: Pool) -> Pool:
        parts = (self.data, other.data), (self.start, other.start + len(self.data)), (self.size, other.size)
        return Pool(*map(np.concatenate, parts))

    def take(self, index: np.ndarray) -> Pool:
        size = self.size[index]
        end = np.concatenate(([0], np.cumsum(size)))
        kind = np.int32 if max(end[-1], len(self.data)) < 1 << 31 else np.int64
        place = np.repeat((self.start[index] - end[:-1]).astype(kind), size)
        place += np.arange(end[-1], dtype=kind)
        return Pool(self.data[place], end[:-1], size)

    def bounds(self, first: np.ndarray) -> np.ndarray:
        """Where each text begins, of which `first` gives the first string (one more at the end)."""
        return np.append(self.start, len(self.data))[first]


class Stretches:
    """Known stretches in flat arrays, found by their hash: ids as a decimal line, what they decode to, how many."""

    def __init__(self):
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.line, self.text, self.count = Pool.of([]), Pool.of([]), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each stretch; -1 where it is not known."""
        if not len(self):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        return np.where(self.hashes[at] == hashes, self.place[at], -1)

    def add(self, hashes: np.ndarray, line: Pool, text: Pool, count: np.ndarray) -> None:
        """Stretches that are not known yet; numbers of known ones stay."""
        place = np.concatenate((self.place, len(self) + np.arange(len(hashes))))
        hashes = np.concatenate((self.hashes, hashes))
        order = hashes.argsort(kind="stable")
        self.hashes, self.place = hashes[order], place[order]
        self.line, self.text, self.count = self.line.plus(line), self.text.plus(text), np.concatenate((self.count, count))


def _numbers(lines: np.ndarray) -> np.ndarray:
    """The numbers of a decimal line with a comma after every number."""
    comma = lines == 0x2C
    end = np.flatnonzero(comma)
    if not len(end):
        return np.zeros(0, np.int32)
    begin = np.concatenate(([0], end[:-1] + 1))
    power = np.maximum(np.repeat(end, end - begin + 1) - np.arange(len(lines)) - 1, 0)
    digits = np.where(comma, 0, lines.astype(np.int64) - 0x30)
    return np.add.reduceat(digits * 10**power, begin).astype(np.int32)


@dataclass
class Encoded:
    """Ids of texts, as the distinct stretches of a slice and the stretches of every text, and what they decode to."""

    pool: Pool
    count: np.ndarray
    index: np.ndarray
    first: np.ndarray
    text: Pool
    apart: dict[int, tuple[str, str, int]]

    def ids(self) -> pa.ListArray:
        """The ids of every text as a list of 32-bit numbers; only distinct stretches are parsed."""
        if self.apart:
            return pa.array([list(map(int, line.split(b","))) if line else [] for line, _, _ in self], pa.list_(pa.int32()))
        parsed = Pool(_numbers(self.pool.data), np.cumsum(self.count) - self.count, self.count).take(self.index)
        return pa.ListArray.from_arrays(pa.array(parsed.bounds(self.first), pa.int32()), pa.array(parsed.data, pa.int32()))

    def __iter__(self) -> Iterator[tuple[bytes, bytes, int]]:
        """For every text its line without the last comma, the decoded bytes and the number of ids."""
        lines = self.pool.take(self.index)
        line, text = lines.data.tobytes(), self.text.data.tobytes()
        at, to = lines.bounds(self.first).tolist(), self.text.bounds(self.first).tolist()
        sizes = np.diff(np.concatenate(([0], np.cumsum(self.count[self.index])))[self.first])
        for i, n in enumerate(sizes.tolist()):
            if i in self.apart:
                ids, decoded, n = self.apart[i]
                yield ids.encode(), decoded.encode(), n
            else:
                yield line[at[i] : max(at[i], at[i + 1] - 1)], text[to[i] : to[i + 1]], n


class Codec:
    """One vocabulary file, with what has been learnt about its pieces and pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        stand = byte_alphabet()
        as_bytes = lambda token: bytes(stand[c] for c in token)
        self.id_of = {as_bytes(token): i for token, i in stored["model"]["vocab"].items()}
        self.rank, self.made = {}, []
        for place, pair in enumerate(stored["model"]["merges"]):
            left, right = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank.setdefault((self.id_of[left], self.id_of[right]), place)
            self.made.append(self.id_of[left + right])
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.bytes_of = {i: token for token, i in self.id_of.items()}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        self.names = {i: str(i) for i in self.bytes_of}
        self._build_trie()
        size = max(self.bytes_of) + 1
        order = np.array([a * size + b for a, b in self.rank], np.int64)
        place = np.array(list(self.rank.values()), np.int64)
        self.pair_keys, self.pair_place = order[order.argsort()], place[order.argsort()]
        self.pair_base, self.made_ids = size, np.array([*self.made, -1], np.int64)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.piece = regex.compile(PATTERN)
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.known, self.older = Stretches(), Stretches()
        self.plain = {str(i): token for i, token in self.bytes_of.items()}
        self.counts = {"pieces": 0, "pairs": 0, "merged": 0}

    def merge(self, data: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, leftmost among equals."""
        ids = list(map(self.byte_ids.__getitem__, data))
        if len(ids) > 256:
            return self._merge_long(ids)
        rank, never, made = self.rank.get, len(self.made), self.made
        ranks = [rank(p, never) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked positions, for pieces of any length."""
        from heapq import heapify, heappop, heappush

        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.rank
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j] = self.made[rank[left, right]], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (r := rank.get((ids[i], ids[after[i]]))) is not None:
                    heappush(heap, (r, i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (r := rank.get((ids[before[i]], ids[i]))) is not None:
                heappush(heap, (r, before[i], ids[before[i]], ids[i]))
        return [x for x in ids if x >= 0]

    def _build_trie(self) -> None:
        """The edges of the trie as sorted keys (node and byte), and the token that ends at every node (-1: none)."""
        edges: dict[int, int] = {}
        ends = [-1]
        for token, i in self.id_of.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(ends)
                    ends.append(-1)
            ends[node] = i
        keys, below = np.array([*edges], np.int64), np.array([*edges.values()], np.int32)
        order = keys.argsort()
        self.edges, self.below, self.ends = keys[order], below[order], np.array(ends, np.int32)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node below by a byte; 0 where there is none."""
        key = node.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.below[at], 0)

    def propose(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all pieces side by side: token ids and the piece of each, in order."""
        who = np.flatnonzero(size > 0)
        at, stop = start[who].copy(), start[who] + size[who]
        node, token, ended = np.zeros(len(who), np.int32), np.full(len(who), -1, np.int32), at.copy()
        ids, owners = [], []
        while len(who):
            open_ = at < stop
            below = self._step(node, data[np.where(open_, at, 0)]) * open_
            at = at + 1
            hit = self.ends[below]
            good = hit >= 0
            token, ended = np.where(good, hit, token), np.where(good, at, ended)
            over = below == 0
            node = below
            if over.any():
                ids.append(token[over])
                owners.append(who[over])
                at = np.where(over, ended, at)
                left = ~over | (at < stop)
                if not left.all():
                    who, at, stop, node, token, ended = (x[left] for x in (who, at, stop, node, token, ended))
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.concatenate(owners)
        order = owner.argsort(kind="stable")
        return np.concatenate(ids)[order].astype(np.int64), owner[order]

    def _places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; the number of merges where there is none."""
        key = left * self.pair_base + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_place[at], len(self.made))

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """`merge` of many pieces side by side: every step merges the best pair of each."""
        out: list = [None] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for low, high in ((0, 8), (8, 16), (16, 48)):
            who = np.flatnonzero((size > low) & (size <= high))
            if not len(who):
                continue
            flat = np.frombuffer(b"".join(pieces[i].ljust(high, b"\0") for i in who), np.uint8).reshape(len(who), high)
            ids = np.where(np.arange(high) < size[who, None], np.array(self.byte_ids, np.int64)[flat], -1)
            ranks = self._places(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(who), high - 1)
            places = np.arange(high)
            while len(who):
                best = ranks.argmin(axis=1)
                rows = np.arange(len(who))
                won = ranks[rows, best]
                done = won == len(self.made)
                if done.any():
                    for i, line in zip(who[done].tolist(), ids[done].tolist(), strict=True):
                        out[i] = line[: line.index(-1)] if line[-1] < 0 else line
                    who, ids, ranks, best, won = (x[~done] for x in (who, ids, ranks, best, won))
                    rows = rows[: len(who)]
                    if not len(who):
                        break
                shift = np.minimum(places + (places > best[:, None]), high - 1)
                ids = np.take_along_axis(ids, shift, 1)
                ids[:, -1] = -1
                ids[rows, best] = self.made_ids[won]
                ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], high - 2), 1)
                ranks[:, -1] = len(self.made)
                before = np.maximum(best - 1, 0)
                ranks[rows, before] = self._places(ids[rows, before], ids[rows, before + 1])
                here = np.minimum(best, high - 2)
                ranks[rows, here] = self._places(ids[rows, here], ids[rows, here + 1])
        for i in np.flatnonzero((size == 0) | (size > 48)).tolist():
            out[i] = self.merge(pieces[i])
        return out

    def _verdicts(self, keys: np.ndarray, memory: dict[int, bool], parts) -> np.ndarray:
        """For every key, whether merging the bytes of its tokens gives just these tokens; asked once a key."""
        distinct, back = np.unique(keys, return_inverse=True)
        new = [parts(k) for k in distinct.tolist() if k not in memory]
        merged = self.merge_all([b"".join(self.bytes_of[i] for i in ids) for _, ids in new])
        memory.update((key, got == ids) for (key, ids), got in zip(new, merged, strict=True))
        return np.fromiter(map(memory.__getitem__, distinct.tolist()), bool, len(distinct))[back]

    def _proposed(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int], list[list[int]]]:
        """Proposed ids with their piece, the pieces whose proposal fails, and the merged ids of these."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(size) - size
        flat, owner = self.propose(np.frombuffer(b"".join(pieces), np.uint8), start, size)
        wrong = np.zeros(len(pieces), dtype=bool)
        good = self._verdicts(flat, self.whole, lambda k: (k, [k]))
        wrong[owner[~good]] = True
        inner = owner[1:] == owner[:-1]
        keys = flat[:-1][inner] << 20 | flat[1:][inner]
        good = self._verdicts(keys, self.pairs, lambda k: (k, [k >> 20, k & 0xFFFFF]))
        wrong[owner[1:][inner][~good]] = True
        if len(self.pairs) > 2 * REMEMBERED:
            self.pairs.clear()
        failing = np.flatnonzero(wrong).tolist()
        self.counts["pieces"] += len(pieces)
        self.counts["pairs"] += len(keys)
        self.counts["merged"] += len(failing)
        return flat, owner, failing, self.merge_all([pieces[i] for i in failing])

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of distinct pieces: proposals, kept where every token and every adjacent pair is right."""
        if not pieces:
            return []
        flat, owner, failing, merged = self._proposed(pieces)
        ids, bounds = flat.tolist(), np.searchsorted(owner, np.arange(len(pieces) + 1)).tolist()
        found = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i, own in zip(failing, merged, strict=True):
            found[i] = own
        return found

    def count_pieces(self, pieces: list[bytes]) -> list[int]:
        """How many ids each of the pieces has."""
        if not pieces:
            return []
        _, owner, failing, merged = self._proposed(pieces)
        found = np.bincount(owner, minlength=len(pieces))
        found[failing] = list(map(len, merged))
        return found.tolist()

    def _runs(self, text: str) -> Iterator[tuple[bool, str]]:
        """Stretches of ordinary text and the special tokens between them."""
        at = 0
        for hit in self.cut.finditer(text):
            yield False, text[at : hit.start()]
            yield True, hit[0]
            at = hit.end()
        yield False, text[at:]

    def _text_ids(self, text: str) -> list[int]:
        """Ids of one text, with special tokens that stand in it."""
        out = []
        for special, run in self._runs(text):
            if special:
                out.append(self.special[run])
            else:
                for ids in self.encode_pieces([p.encode() for p in self.piece.findall(run)]):
                    out += ids
        return out

    def _learn(self, units: list[bytes]) -> tuple[Pool, Pool, np.ndarray]:
        """Encode new stretches: for each its ids as a line, the text these ids decode to, and their number."""
        as_text = [u.decode() for u in units]
        pieces = [[u] if (u[1:] if u[0] == " " else u).isalpha() else self.piece.findall(u) for u in as_text]
        distinct = list(set().union(*pieces))
        name, spelt = self.names.__getitem__, self.bytes_of.__getitem__
        ids = self.encode_pieces([p.encode() for p in distinct])
        known = {p: ((",".join(map(name, i)) + ",").encode(), b"".join(map(spelt, i)), len(i)) for p, i in zip(distinct, ids, strict=True)}
        found = []
        for parts in pieces:
            if len(parts) == 1:
                found.append(known[parts[0]])
            else:
                line, text, size = zip(*map(known.__getitem__, parts), strict=True)
                found.append((b"".join(line), b"".join(text), sum(size)))
        lines, texts, counts = zip(*found, strict=True)
        return Pool.of(lines), Pool.of(texts), np.array(counts, np.int64)

    def forget(self) -> None:
        """Let go of stretches and pairs: a worker process may serve other operators next."""
        self.known, self.older = Stretches(), Stretches()
        self.pairs.clear()

    def encode_slice(self, texts: Texts) -> Encoded:
        """All texts of a slice: distinct stretches are encoded once, and gathered per text."""
        gc.disable()  # millions of small objects without cycles
        try:
            return self._encode_slice(texts)
        finally:
            gc.enable()

    def _encode_slice(self, texts: Texts) -> Encoded:
        data, offsets = texts.data, texts.offsets
        raw = data.tobytes()
        cuts = _safe_cuts(data, offsets)
        ends = np.append(cuts[1:], len(data))[: len(cuts)]
        first = np.searchsorted(cuts, offsets)
        hashes = word_hashes(texts, Words(cuts, ends, first))
        distinct, seen, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known, self.older = Stretches(), self.known
        missing = np.flatnonzero(self.known.find(distinct) < 0)
        if len(missing) and len(self.older):
            at = self.older.find(distinct[missing])
            old, again = at[at >= 0], missing[at >= 0]
            self.known.add(distinct[again], self.older.line.take(old), self.older.text.take(old), self.older.count[old])
            missing = missing[at < 0]
        for a in range(0, len(missing), LEARNT):
            new = missing[a : a + LEARNT]
            places = zip(cuts[seen[new]].tolist(), ends[seen[new]].tolist(), strict=True)
            self.known.add(distinct[new], *self._learn([raw[i:j] for i, j in places]))
        known, index = self.known, self.known.find(distinct)
        text = known.text.take(index[back])
        out = Encoded(known.line.take(index), known.count[index], back, first, text, {})
        for i in self._doubtful(raw, data, offsets, text.data, text.bounds(first)):
            ids = self._text_ids(raw[offsets[i] : offsets[i + 1]].decode())
            out.apart[i] = ",".join(map(str, ids)), self.decode_line(",".join(map(str, ids))), len(ids)
        return out

    def _doubtful(self, raw, data, offsets, text, text_at) -> list[int]:
        """Texts that hold a special token, or do not decode to themselves (two stretches with one hash)."""
        found = set()
        for token in self.special:
            at = raw.find(token.encode())
            while at >= 0:
                found.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token.encode(), at + 1)
        if not np.array_equal(text, data):
            found |= {i for i in range(len(offsets) - 1) if text[text_at[i] : text_at[i + 1]].tobytes() != raw[offsets[i] : offsets[i + 1]]}
        return sorted(found)

    def decode_line(self, line: str) -> str:
        """Text of comma-joined ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.plain.__getitem__, line.split(","))).decode("utf-8", "replace") if line else ""


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
        give_back()
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `ids` (array of int): the whole text encoded.

    `vocabulary` is a path every executor can open (a file of an installed package).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(vocabulary)
        for batch in batches:
            for part in slices(batch):
                ids = known.encode_slice(texts_of(part.column("text"))).ids()
                yield pa.RecordBatch.from_arrays([part.column("key"), ids], ["key", "ids"])
        known.forget()

    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(tidied(run), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(tokens: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key`, `text`: the texts of arrays of ids (null: empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(vocabulary)
        for batch in batches:
            texts = [known.decode_line(",".join(map(str, x or []))) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    chosen = tokens.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(tidied(run), f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256`: encoded and decoded in one pass, as digests."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(vocabulary)
        digest = lambda s: hashlib.sha256(s).hexdigest()
        for batch in batches:
            for part in slices(batch):
                rows = [(n, digest(line), digest(text)) for line, text, n in known.encode_slice(texts_of(part.column("text")))]
                columns = zip(*rows, strict=True)
                arrays = [pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )
        known.forget()

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
