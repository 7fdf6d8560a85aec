"""Plain versions of what the operators compute, and awkward rows for all of them."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def awkward(spark):
    """Nulls everywhere, empty, blank, very long, repeated and clashing rows."""
    base = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, base, "en", "a", "x"), (2, base, "en", None, None), (2, base, "en", None, None), (3, base.upper(), None, "a", "x"),
        (4, None, None, None, None), (5, "", "en", "b", "x"), (6, " \t\n ", "en", "b", "x"), (7, "one", "en", "b", "x"),
        (8, "long " * 30_000, "en", "c", "x"), (9, base + " tail of its own", "de", "c", "x"), (10, "é𠀀\x00'll 12  a\n\nb", "fr", "c", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words string")


def shingles(text, size=5):
    words = WORD.findall(folded(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_components(rows):
    """doc_id -> (set size, smallest id reachable over links of at least 75 percent)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in seen.get(s, ()))
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            seen.setdefault(s, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def without_repeats(rows, window=50):
    """doc_id -> (all words, kept words): windows that start in a smaller document go."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = w, [x for x, g in zip(w, gone, strict=True) if not g]
    return out


def documents(spark, folder=FOLDER):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
