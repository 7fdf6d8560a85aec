"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regular expression over lower-cased text with words it cannot match without, a priority and a
label. Only rules whose words all stand in a text, in any place, run on it: a rule may be matched over line ends, so its
words are sought one by one. Alternatives of a rule have words of their own. Overlapping detections are resolved by
priority: one that lies inside the interval of a stronger one is suppressed (of equal priority the
longer wins, then the earlier, then the smaller label); partial overlaps stay.

Base phrases are found apart from the rules, word by word, and their labels always stay.

Defined results: a null text counts as empty; a text without detections has no words of a first or last
place, empty label lists and score 0; texts of any length are scanned whole; repeated rows repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.words import lowered, slices, texts_of, words_of

#: Base phrases and their labels.
PHRASES = (
    (("under", "the", "mit", "license"), "mit"),
    (("apache", "license", "version", "2"), "apache-2"),
    (("cc", "by", "nc"), "cc-by-nc"),
)

#: Word bytes of the scan after lower-casing: digits, a-z and everything beyond ASCII.
_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_GAP = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_EDGE = r"[0-9a-z\x80-\xff]"


@dataclass(frozen=True)
class Rule:
    keyword: bytes  # words that every match holds; alternatives are parted by "|"
    pattern: str
    priority: int
    label: str


#: Families: label stem, prefilter words, expression of the name, versions (as label suffixes).
FAMILIES = (
    ("mit", "mit|expat", r"(?:mit|expat)(?:/x11)?(?:[ -]style)?", ()),
    ("apache", "apache", r"apache(?: software)?(?: foundation)?", ("1.0", "1.1", "2")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "3")),
    ("gpl", "general public", r"(?:gnu )?general public", ("1", "2", "3")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2.1", "3")),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public", ("2", "2.1", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3")),
    ("agpl", "affero", r"(?:gnu )?affero general public", ("1", "3")),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", ("1.1", "1.2", "1.3")),
    ("mpl", "mozilla", r"mozilla public", ("1.0", "1.1", "2")),
    ("mpl", "mpl", r"mpl", ("1.0", "1.1", "2")),
    ("epl", "eclipse", r"eclipse public", ("1", "2")),
    ("cddl", "cddl", r"cddl", ("1.0", "1.1")),
    ("cddl", "common development", r"common development and distribution", ("1.0", "1.1")),
    ("eupl", "eupl", r"eupl", ("1.0", "1.1", "1.2")),
    ("eupl", "european union public", r"european union public", ("1.0", "1.1", "1.2")),
    ("artistic", "artistic", r"artistic", ("1", "2")),
    ("bsd", "bsd", r"(?:new |modified |simplified |revised )?bsd", ("2-clause", "3-clause", "4-clause")),
    ("0bsd", "0bsd", r"0bsd", ()),
    ("isc", "isc", r"isc", ()),
    ("zlib", "zlib", r"zlib(?:/libpng)?", ()),
    ("bsl", "boost", r"boost software", ("1.0",)),
    ("ofl", "open font", r"(?:sil )?open font", ("1.0", "1.1")),
    ("ms-pl", "microsoft public", r"microsoft public", ()),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", ()),
    ("psf", "python software", r"python software foundation", ("2",)),
    ("php", "php", r"php", ("3.0", "3.01")),
    ("ruby", "ruby", r"ruby", ()),
    ("postgresql", "postgresql", r"postgresql", ()),
    ("openssl", "openssl", r"openssl", ()),
    ("x11", "x11", r"x11", ()),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)?", ()),
    ("vim", "vim", r"vim", ()),
    ("zpl", "zope", r"zope public", ("1.1", "2.0", "2.1")),
    ("odbl", "open database", r"open database", ("1.0",)),
    ("odc-by", "open data commons", r"open data commons attribution", ("1.0",)),
    ("cecill", "cecill", r"cecill(?:-[abc])?", ("1.0", "2.0", "2.1")),
    ("upl", "universal permissive", r"universal permissive", ("1.0",)),
    ("llama", "llama", r"llama(?: [23])? community", ()),
    ("openrail", "open rail", r"(?:creativeml )?open ?rail(?:-m)?", ()),
)

#: Creative Commons: label and expression of the terms.
COMMONS = (
    ("cc-by", r"by|attribution"),
    ("cc-by-sa", r"by[ -]sa|attribution[ -]share[ -]?alike"),
    ("cc-by-nd", r"by[ -]nd|attribution[ -]no[ -]?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc", r"by[ -]nc|attribution[ -]non[ -]?commercial"),
    ("cc-by-nc-sa", r"by[ -]nc[ -]sa|attribution[ -]non[ -]?commercial[ -]share[ -]?alike"),
    ("cc-by-nc-nd", r"by[ -]nc[ -]nd|attribution[ -]non[ -]?commercial[ -]no[ -]?deriv(?:ative)?s?(?: works)?"),
)

#: Single signatures: prefilter words, expression, priority, label.
SINGLE = (
    ("unlicen", r"(?:the )?unlicen[sc]e", 60, "unlicense"),
    ("public domain", r"(?:dedicated to|released into|in) the public domain", 65, "public-domain"),
    ("cc0", r"cc0(?: ?1\.0)?(?: universal)?", 75, "cc0"),
    ("wtfpl|what you want public", r"wtfpl|do what the f\w* you want to public licen[sc]e", 70, "wtfpl"),
    ("all rights reserved", r"all rights reserved", 40, "proprietary"),
    ("proprietary and confidential", r"proprietary and confidential", 70, "proprietary"),
    ("permission is hereby granted", r"permission is hereby granted, free of charge, to any person", 55, "mit"),
    ("redistribution source binary forms", r"redistribution and use in source and binary forms", 55, "bsd"),
    ("permission copy modify distribute", r"permission to use, copy, modify,? and/?o?r? distribute this software", 55, "isc"),
    ("terms gnu general public", r"under the terms of the gnu general public licen[sc]e", 72, "gpl"),
    ("share and adapt", r"free to share and adapt", 45, "cc-by"),
    ("open government licen", r"open government licen[sc]e(?: v?[123](?:\.0)?)?", 70, "ogl-uk"),
    ("etalab|licence ouverte", r"licence ouverte|etalab(?: 2\.0)?", 70, "etalab"),
    ("beer ware licen", r"beer-?ware licen[sc]e", 60, "beerware"),
)

#: What surrounds a name: priority and expression. The more it says, the stronger it is.
CONTEXTS = (
    (90, r"(?:licen[sc]ed|released|distributed|available|published|shared) under (?:the )?(?:terms of )?(?:the |an? )?{name}"),
    (85, r"licen[sc]e ?: ?(?:the )?{name}"),
    (60, r"(?:the )?{name}"),
)


def build_rules() -> list[Rule]:
    """All signatures: families times versions times contexts, Creative Commons terms, single ones."""
    rules = []
    for stem, keyword, name, versions in FAMILIES:
        forms = [(stem, rf"{name}(?: public)? licen[sc]e", 0)]
        for v in versions:
            if "clause" in v:
                number = {"2": "2|two", "3": "3|three", "4": "4|four"}[v[0]]
                forms.append((f"{stem}-{v[0]}", rf"(?:{name} (?:{number})[ -]clause|(?:{number})[ -]clause {name})(?: licen[sc]e)?", 5))
            else:
                digits = re.escape(v) + (r"(?:\.0)?" if "." not in v else "")
                forms.append((f"{stem}-{v}", rf"{name}(?: public)?(?: licen[sc]e)?,?[ -](?:version |v\.? ?)?{digits}(?![0-9]|\.[0-9])", 5))
        for label, form, bonus in forms:
            rules += [Rule(keyword.encode(), c.format(name=form), p + bonus, label) for p, c in CONTEXTS]
        for v in ("", *(v for v in versions if "clause" not in v)):
            spdx = stem + (f"-{v}" if v else "")
            rules.append(Rule(b"spdx-license", rf"spdx-license-identifier: ?{re.escape(spdx)}(?:\.0)?(?:-only|-or-later|\+)?(?![0-9a-z.-])", 100, spdx))
    for label, terms in COMMONS:
        named = rf"(?:creative commons|cc)[ -](?:{terms})(?! ?[-]?(?:sa|nc|nd)\b)(?: (?:international |unported )?(?:licen[sc]e,?)?)?(?: ?v?[1-4]\.[05])?"
        rules += [Rule(b"creative commons|cc", c.format(name=named), p + label.count("-"), label) for p, c in CONTEXTS]
        rules.append(Rule(b"creativecommons.org", rf"creativecommons\.org/licenses/{label[3:]}/[1-4]\.[05]", 95, label))
    rules += [Rule(k.encode(), p, rank, label) for k, p, rank, label in SINGLE]
    return rules


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        self.by_keyword: dict[bytes, list[tuple[re.Pattern, int, str]]] = {}
        for rule in build_rules() if rules is None else rules:
            # the blank of an expression stands for any white space of the text
            spaced = re.sub(r"\[ -\]|(?<!\[) (?![?*+-])", lambda m: r"[\x09-\x0d -]" if len(m[0]) > 1 else r"[\x09-\x0d ]+", rule.pattern)
            edged = rf"(?<!{_EDGE})(?:{spaced})(?!{_EDGE})"
            self.by_keyword.setdefault(rule.keyword, []).append((re.compile(edged.encode("latin-1")), rule.priority, rule.label))
        self.needs = {k: [frozenset(words.split()) for words in k.split(b"|")] for k in self.by_keyword}
        self.base = [
            ([w.encode() for w in words], re.compile(f"(?<!{_EDGE}){_GAP.join(words)}(?!{_EDGE})".encode("latin-1")), label)
            for words, label in PHRASES
        ]

    def detect(self, text: bytes, keywords: Iterable[bytes]) -> list[tuple[int, int, int, str]]:
        """What stays of all matches: (start, end, priority, label) in order of place."""
        found = set()
        for keyword in keywords:
            for pattern, priority, label in self.by_keyword[keyword]:
                found.update((m.start(), m.end(), priority, label) for m in pattern.finditer(text))
        return resolve(found)


def resolve(found: Iterable[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Drop detections whose interval lies inside a stronger one's.

    Sorted by start (the longer first), an interval lies inside an earlier one if that one ends no sooner:
    it is enough to keep, for every priority, the furthest end so far.
    """
    ordered = sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3]))
    furthest: dict[int, int] = {}
    stays = []
    for begin, end, priority, label in ordered:
        if not any(p >= priority and e >= end for p, e in furthest.items()):
            stays.append((begin, end, priority, label))
        furthest[priority] = max(end, furthest.get(priority, -1))
    # an equal start sorts the longer first, so a weaker longer one may hold a stronger shorter one: both stay
    return stays


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections array<struct<start:int,end:int,priority:int,label:string>>"
)


def _rows_with(raw: bytes, offsets: np.ndarray, word: bytes) -> set[int]:
    """Texts in which a word stands, also inside other words."""
    rows, at = set(), raw.find(word)
    while at >= 0:
        row = int(np.searchsorted(offsets, at, "right")) - 1
        if at + len(word) <= offsets[row + 1]:
            rows.add(row)
            at = raw.find(word, offsets[row + 1])  # one place in a text is enough
        else:
            at = raw.find(word, at + 1)
    return rows


def _scan_slice(part: pa.RecordBatch) -> pa.RecordBatch:
    known = scanner()
    texts = lowered(texts_of(part.column("text")))
    words = words_of(texts, _BREAK)
    raw, offsets = texts.data.tobytes(), texts.offsets
    stands = {w: _rows_with(raw, offsets, w) for w in set().union(*(words for some in known.needs.values() for words in some))}
    hits: dict[int, set[bytes]] = {}
    for keyword, some in known.needs.items():
        for row in set().union(*(set.intersection(*(stands[w] for w in words)) for words in some)):
            hits.setdefault(row, set()).add(keyword)
    rows = []
    for i in range(len(texts)):
        keywords = hits.get(i)
        places, base, detections = [], set(), []
        if keywords:
            text = raw[offsets[i] : offsets[i + 1]]
            for phrase, pattern, label in known.base:
                if all(w in text for w in phrase):
                    starts = [m.start() for m in pattern.finditer(text)]
                    places += starts
                    if starts:
                        base.add(label)
            detections = known.detect(text, keywords)
        own = words.start[words.first[i] : words.first[i + 1]] - offsets[i]
        at = np.searchsorted(own, sorted(places)).tolist()
        strength = max([1.0 if base else 0.0, *(p / 100 for _, _, p, _ in detections)])
        rows.append(
            (
                len(places), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)),
                ",".join(sorted(base | {d[3] for d in detections})), min(1.0, strength),
                [dict(zip(("start", "end", "priority", "label"), d, strict=True)) for d in detections],
            )
        )
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    found = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("priority", pa.int32()), ("label", pa.string())]))
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (*kinds, found), strict=True)]
    names = ["n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(words.counts, pa.int64()), *columns], ["doc_id", "n_words", *names]
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: word counts, base phrases, labels, score and the detections that stay.

    Detections are byte intervals of the lower-cased UTF-8 text. No row leaves its partition.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _scan_slice(part)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
