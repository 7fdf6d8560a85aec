"""Column helpers for exact, code-point based text work. No Python UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns. They are valid for both java.util.regex and RE2.
LINE_PATTERN = r"[^\n]*\n|[^\n]+"
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}]+|[ \t\n\r]+|[^\p{L}\p{M}\p{N} \t\n\r]"
CHAR_PATTERN = r"(?s)."
LEVEL_PATTERNS = {"line": LINE_PATTERN, "token": TOKEN_PATTERN, "char": CHAR_PATTERN}

# The characters Python's str.strip()/isspace() treat as white space.
SPACE_CLASS = (
    r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Sentence punctuation, and the CJK ranges that never join tokens.
SENTENCE_PUNCTUATION = "，,。.！!？?；;：:"
CJK_CLASS = (
    r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
    r"\x{20000}-\x{2ebef}\x{30000}-\x{323af}"
)
FORMAT_ONLY = rf"\A[{SENTENCE_PUNCTUATION}{SPACE_CLASS}]+\z"
WORD_CHARACTER = r"\A[\p{L}\p{M}\p{N}]\z"
CJK_CHARACTER = rf"\A[{CJK_CLASS}]\z"
STRIP_PATTERN = rf"\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z"

_STEPS = [1 << power for power in range(30, -1, -1)]


def tokens(text: Column, level: str) -> Column:
    """All tokens in order; concatenating them gives the text back."""
    return F.regexp_extract_all(text, F.lit(LEVEL_PATTERNS[level]), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP_PATTERN, "")


def piece(text: Column, start: Column, end: Column) -> Column:
    """Half-open slice [start, end) in code points."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


# Code points per block. A slice then costs a block, not the whole text before it.
BLOCK = 4096


def blocks(text: Column) -> Column:
    """The text cut into blocks of equal length, for many slices of one long text."""
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / BLOCK).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK))
    )


def block_piece(cut: Column, start: Column, end: Column) -> Column:
    """Half-open slice [start, end) of a text given as its blocks."""
    first = F.floor(start / BLOCK)
    count = F.floor(end / BLOCK) - first + 1
    near = F.array_join(F.slice(cut, (first + 1).cast("int"), count.cast("int")), "")
    size = (end - start).cast("int")
    return F.when(
        F.size(cut) == 1, F.substring(F.get(cut, F.lit(0)), (start + 1).cast("int"), size)
    ).otherwise(F.substring(near, (start - first * BLOCK + 1).cast("int"), size))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions)


def common_prefix(texts: list[Column]) -> Column:
    """Length shared from the left, found by doubling steps (prefix equality is monotone)."""
    first, rest = texts[0], texts[1:]
    limit = F.least(*[F.length(t) for t in texts])

    def grow(done: Column, step: Column) -> Column:
        same = _all(
            [F.substring(first, done + 1, step) == F.substring(t, done + 1, step) for t in rest]
        )
        return F.when((done + step <= limit) & same, done + step).otherwise(done)

    return F.aggregate(F.array(*[F.lit(s) for s in _STEPS]), F.lit(0), grow)


def common_suffix(texts: list[Column], limit: Column) -> Column:
    """Length shared from the right, at most `limit`."""
    first, rest = texts[0], texts[1:]

    def tail(text: Column, done: Column, step: Column) -> Column:
        return F.substring(text, F.length(text) - done - step + 1, step)

    def grow(done: Column, step: Column) -> Column:
        same = _all([tail(first, done, step) == tail(t, done, step) for t in rest])
        return F.when((done + step <= limit) & same, done + step).otherwise(done)

    return F.aggregate(F.array(*[F.lit(s) for s in _STEPS]), F.lit(0), grow)


def is_joining_character(character: Column) -> Column:
    """A letter, mark or number outside the CJK ranges; false for a missing neighbour."""
    return F.coalesce(
        character.rlike(WORD_CHARACTER) & ~character.rlike(CJK_CHARACTER), F.lit(False)
    )


def hunk_category(
    base_piece: Column,
    base_left: Column,
    base_right: Column,
    variant_piece: Column,
    variant_left: Column,
    variant_right: Column,
) -> Column:
    """`prosodic_format_only` when only sentence marks or space differ and no token is joined."""

    def joins(fragment: Column, left: Column, right: Column) -> Column:
        follows = is_joining_character(right)
        return follows & (fragment.endswith(".") | is_joining_character(left))

    format_only = F.concat(base_piece, variant_piece).rlike(FORMAT_ONLY)
    lexical = joins(base_piece, base_left, base_right) | joins(
        variant_piece, variant_left, variant_right
    )
    return F.when(format_only & ~lexical, "prosodic_format_only").otherwise("lexical")
