"""Anchors and gaps of the sides of one document: plain functions over strings, run inside tasks.

A side is one cell, so a document's sides are in one task anyway. Positions are code points.
Letters, marks and numbers are those of the Unicode version of the tasks' Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache, reduce
from itertools import accumulate, chain, compress

import numpy as np

_LINES = re.compile(r"[^\n]*\n|[^\n]+")
_ASCII_TOKENS = re.compile(r"(?s)[A-Za-z0-9]+|[ \t\n\r]+|.")
#: Texts up to this length are searched for single characters instead of being counted.
_SHORT = 64
#: From this many characters of all sides on, tokens are numbers in arrays instead of strings: the same gaps.
_ARRAYS = 500
#: A token of up to eight bytes is these bytes as a number; a longer one a number above, as no byte is 255.
_MASKS = np.array([(1 << 8 * size) - 1 for size in range(9)], np.uint64)
_LONG = np.uint64(255 << 56)


@cache
def _word_ranges() -> list[tuple[int, int]]:
    """First and last code points of the runs of letters, marks and numbers."""
    ranges, first = [], None
    for code in range(0x110001):
        inside = code < 0x110000 and unicodedata.category(chr(code))[0] in "LMN"
        if inside and first is None:
            first = code
        elif not inside and first is not None:
            ranges.append((first, code - 1))
            first = None
    return ranges


@cache
def _unicode_tokens() -> re.Pattern:
    """`TOKEN_PATTERN` for `re`, which has no classes by category."""
    word = "".join(f"\\U{first:08x}-\\U{last:08x}" for first, last in _word_ranges())
    return re.compile(rf"(?s)[{word}]+|[ \t\n\r]+|.")


@cache
def _kinds() -> np.ndarray:
    """By code point: 0 is a token of its own; neighbours of kind 1 (white space) or 2 (word) are one."""
    kinds = np.zeros(0x110000, np.uint8)
    kinds[[ord(c) for c in " \t\n\r"]] = 1
    for first, last in _word_ranges():
        kinds[first : last + 1] = 2
    return kinds


#: `_kinds` of the code points below 128, as a table of `bytes.translate`.
_ASCII_KINDS = bytes(2 if chr(c).isalnum() else chr(c) in " \t\n\r" for c in range(128)) + bytes(128)


def split(text: str, level: str) -> Sequence[str]:
    """Lines, tokens or characters in order; joined they give the text back."""
    if level == "char":
        return text
    if level == "line":
        return _LINES.findall(text)
    return (_ASCII_TOKENS if text.isascii() else _unicode_tokens()).findall(text)


def _uncrossed(places: list[list[int]]) -> list[bool]:
    """Which entries, in the order of the first side, are in order with all others on every side."""
    keep = [True] * len(places[0])
    for side in places[1:]:
        ahead = accumulate(side, max, initial=-1)
        behind = list(accumulate(reversed(side), min, initial=1 << 62))[-2::-1]
        keep = [k and hi < at < lo for k, hi, at, lo in zip(keep, ahead, side, behind)]
    return keep


def _once(words: Sequence[str]) -> set[str]:
    kinds = set(words)
    return kinds if len(kinds) == len(words) else {word for word, uses in Counter(words).items() if uses == 1}


def anchors(texts: Sequence[str], level: str) -> Iterator[tuple]:
    """(token, its place on each side) of tokens once on every side and crossing no other such token."""
    if not all(texts):
        return
    if level == "char" and len(texts[0]) <= _SHORT:
        shared = set(_once_in_all(texts))
        if not shared:
            return
        found = [{c: at for at, c in enumerate(text) if c in shared} for text in texts]
    else:
        words = [split(text, level) for text in texts]
        shared = _once(words[0])
        for own in words[1:]:
            shared &= _once(own)
        if not shared:
            return
        found = []
        for own in words:
            starts = range(len(own)) if level == "char" else accumulate(map(len, own), initial=0)
            found.append(dict(compress(zip(own, starts), map(shared.__contains__, own))))
    order = list(found[0])
    places = [[side[word] for word in order] for side in found]
    rows = zip(order, *places)
    if all(list(side) == order for side in found[1:]):
        yield from rows
    else:
        yield from compress(rows, _uncrossed(places))


def _numbered(text: str, long: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Where each token starts, and a number that only equal tokens share; `long` has those of long tokens."""
    data = text.encode("utf-8", "surrogatepass")
    if text.isascii():
        kinds, places = np.frombuffer(data.translate(_ASCII_KINDS), np.uint8), None
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, places = _kinds()[codes], np.ones(len(codes), np.int64)
        for wider in (0x80, 0x800, 0x10000):
            places += codes >= wider
        places = np.cumsum(places) - places
    opens = kinds == 0
    opens[0] = True
    opens[1:] |= kinds[1:] != kinds[:-1]
    starts = opens.nonzero()[0]
    begins = starts if places is None else places[starts]
    sizes = np.empty_like(begins)
    np.subtract(begins[1:], begins[:-1], out=sizes[:-1])
    sizes[-1] = len(data) - begins[-1]
    windows = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))
    numbers = windows[begins] & _MASKS.take(sizes, mode="clip")
    beyond = (sizes > 8).nonzero()[0]
    if len(beyond):
        spans = zip(begins[beyond].tolist(), (begins[beyond] + sizes[beyond]).tolist())
        numbers[beyond] = np.array([long.setdefault(data[x:y], len(long)) for x, y in spans], np.uint64) | _LONG
    return starts, numbers


def _alone(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers found once, in their order, and where they are."""
    order = numbers.argsort()
    ordered = numbers[order]
    edges = np.ones(len(ordered) + 1, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=edges[1:-1])
    once = edges[1:] & edges[:-1]
    return ordered[once], order[once]


def _in_order(places: list[np.ndarray]) -> np.ndarray | None:
    """`_uncrossed` of arrays; None if all entries are in order."""
    keep = None
    for side in places[1:]:
        if len(side) > 1 and (side[1:] <= side[:-1]).any():
            behind = np.minimum.accumulate(side[::-1])[::-1]
            own = np.ones(len(side), bool)
            own[1:] &= np.maximum.accumulate(side)[:-1] < side[1:]
            own[:-1] &= side[:-1] < behind[1:]
            keep = own if keep is None else keep & own
    return keep


def _token_gaps(texts: Sequence[str], starts: Sequence[int]) -> Iterator[tuple]:
    """`_between` by tokens, of texts none of which is empty: tokens are numbers, and only gaps become strings."""
    long: dict[bytes, int] = {}
    opens, numbers = zip(*[_numbered(text, long) for text in texts])
    single = [_alone(own) for own in numbers]
    kinds, last = np.sort(np.concatenate([own for own, _ in single])), len(texts) - 1
    shared = kinds[last:][kinds[last:] == kinds[: len(kinds) - last]]
    places = [at[own.searchsorted(shared)] for own, at in single]
    order = places[0].argsort()
    places = [side[order] for side in places]
    keep = _in_order(places)
    if keep is not None:
        places = [side[keep] for side in places]
    # gap k is the tokens from begins[k] to ends[k] of every side
    begins = [np.concatenate(([0], side + 1)) for side in places]
    ends = [np.append(side, len(own)) for side, own in zip(places, numbers)]
    counts = [end - begin for begin, end in zip(begins, ends)]
    differs = reduce(np.logical_or, [own != counts[0] for own in counts[1:]])
    inside = np.ones(len(numbers[0]), bool)
    inside[places[0]] = False
    here, gap = inside.nonzero()[0], np.repeat(np.arange(len(differs)), counts[0])
    for begin, own in zip(begins[1:], numbers[1:]):
        there = own.take(here + (begin - begins[0])[gap], mode="clip")
        differs[gap[there != numbers[0][here]]] = True
    found = differs.nonzero()[0]
    edges = [np.append(own, len(text)) for own, text in zip(opens, texts)]
    lefts = [edge[begin[found]].tolist() for edge, begin in zip(edges, begins)]
    rights = [edge[end[found]].tolist() for edge, end in zip(edges, ends)]
    parts = [[text[x:y] for x, y in zip(left, right)] for text, left, right in zip(texts, lefts, rights)]
    shifted = [[at + x for x in left] for at, left in zip(starts, lefts)]
    yield from zip(map(list, zip(*parts)), map(list, zip(*shifted)))


def _cut(texts: Sequence[str], starts: Sequence[int], found: Iterator[tuple]) -> Iterator[tuple]:
    """(texts, starts) of what lies between the anchors found and is not equal on all sides."""
    done = [0] * len(texts)
    for word, *places in chain(found, [("", *map(len, texts))]):
        if places != done:
            parts = [text[begin:end] for text, begin, end in zip(texts, done, places)]
            if parts[1:] != parts[:-1]:
                yield parts, [at + begin for at, begin in zip(starts, done)]
        size = len(word)
        done = [place + size for place in places]


def _once_in_all(texts: Sequence[str]) -> list[str]:
    """The characters that are once in each of some texts, one of them short."""
    found = []
    for char in set(texts[0]).intersection(*texts[1:]):
        for text in texts:
            if text.count(char) != 1:
                break
        else:
            found.append(char)
    return found


def _char_gaps(texts: Sequence[str], starts: Sequence[int]) -> Iterator[tuple]:
    """`_cut` at the anchors of single characters, of texts one of which is short."""
    shared = _once_in_all(texts)
    if not shared:
        if texts[1:] != texts[:-1]:
            yield texts, starts
        return
    if len(shared) > 1:
        shared.sort(key=texts[0].index)
        places = [list(map(text.index, shared)) for text in texts]
        if any(side != sorted(side) for side in places[1:]):
            shared = list(compress(shared, _uncrossed(places)))
    rests, behind = texts, starts
    for char in shared:
        parts, _, left = zip(*[rest.partition(char) for rest in rests])
        if parts[1:] != parts[:-1]:
            yield parts, behind
        behind = [at + len(part) + 1 for at, part in zip(behind, parts)]
        rests = left
    if rests[1:] != rests[:-1]:
        yield rests, behind


def _between(texts: Sequence[str], starts: Sequence[int], level: str) -> Iterator[tuple]:
    """(texts, starts) of what lies between the anchors and is not equal on all sides."""
    if level == "char" and len(texts[0]) <= _SHORT:
        return _char_gaps(texts, starts)
    if level == "token" and sum(map(len, texts)) >= _ARRAYS and all(texts):
        return _token_gaps(texts, starts)
    return _cut(texts, starts, anchors(texts, level))


def _shared_start(texts: Sequence[str], room: int) -> int:
    """How many characters, at most `room`, all texts begin with."""
    first, *others = texts
    low, high = 0, room
    while low < high:
        # the first step asks for one character: most gaps share none
        size = 1 if not low else (low + high + 1) // 2
        start = first[:size]
        for other in others:
            if not other.startswith(start):
                high = size - 1
                break
        else:
            low = size
    return low


def gaps(texts: Sequence[str], levels: Sequence[str]) -> Iterator[list[tuple[int, str]]]:
    """Where the sides differ, refined level by level: start and text of every side, trimmed."""
    found = [(list(texts), [0] * len(texts))]
    for level in levels:
        found = [gap for parts, starts in found for gap in _between(parts, starts, level)]
    for parts, starts in found:
        head, room = 0, min(map(len, parts))
        if room:
            head = _shared_start(parts, room)
            tail = _shared_start([part[::-1] for part in parts], room - head) if room > head else 0
            if head or tail:
                parts = [part[head : len(part) - tail] for part in parts]
        yield [(at + head, part) for at, part in zip(starts, parts)]
