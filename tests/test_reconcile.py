import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import anchors
from palimpsest.functions.anchors import gaps, split
from palimpsest.operators import reconcile as R

# base, two corrections, merged text, conflicts: one case for every property, of our own making
CASES = [
    ("the cat sat", "the cat sat", "the cat sat", "the cat sat", 0),  # nothing changed
    ("the cat sat", "the dog sat", "the dog sat", "the dog sat", 0),  # the same change twice
    ("the cat sat", "a cat sat", "the cat lay", "a cat lay", 0),  # changes apart
    ("the cat sat", "the dog sat", "the cow sat", "the cat sat", 1),  # different changes of one word
    ("the cat sat", "the big cat sat", "the old cat sat", "the cat sat", 1),  # insertions at one place
    ("the cat sat", "the sat", "the cat sat", "the sat", 0),  # a deletion
    ("the cat sat", "so the cat sat", "the cat sat down", "so the cat sat down", 0),  # both edges
    ("no no no", "no no", "no no no", "no no", 0),  # repeats
    ("caf\u00e9", "cafe\u0301", "caf\u00e9", "cafe\u0301", 0),  # composed and decomposed
    ("x\U0001f600y", "x\U0001f601y", "x\U0001f600y", "x\U0001f601y", 0),  # beyond the basic plane
    ("", "something", "", "something", 0),
    ("something", "", "something", "", 0),
]
PAIRS = [
    ("", "one two"), ("one two", ""), ("nnn", "nn"), ("tictac tictac", "toctac tictac"), ("caf\u00e9", "cafe\u0301"),
    ("Upper", "upper"), ("\U0001f600 left right", "left \U0001f600 right"), ("kept", "kept"), ("p\nq\np\n", "q\np\np\nr"),
]


def merged_characters(base, a, b):
    """Three-way merge of texts of distinct characters that only lose or change characters in place."""
    out = []
    for x, y, z in zip(base, a, b, strict=True):
        if y == z or z == x:
            out.append(y)
        elif y == x:
            out.append(z)
        else:
            return None
    return "".join(out)


@pytest.mark.parametrize("levels", [R.LEVELS, ("char",)])
def test_three_way_literals(spark, levels):
    rows = [(i, base, a, b) for i, (base, a, b, _, _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "doc_id long, base string, a string, b string")
    got = {r.doc_id: r for r in R.reconcile(frame, levels=levels).collect()}
    for i, (base, a, b, preview, conflicts) in enumerate(CASES):
        assert (got[i].preview, got[i].conflicts) == (preview, conflicts), (base, a, b)


def test_adjacent_changes_share_a_component_unless_text_between_survives(spark):
    frame = spark.createDataFrame(
        [(1, "ab", "xb", "ay"), (2, "abc", "xbc", "aby")],
        "doc_id long, base string, a string, b string",
    )
    rows = R.merge_components(frame).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.start, r.end, r.state) for r in rows] == [
        (1, 0, 2, "conflict"), (2, 0, 1, "singleton"), (2, 2, 3, "singleton"),
    ]


def test_hunks_rebuild_the_variant(spark):
    rows = [(i, base, variant) for i, (base, variant) in enumerate(PAIRS)]
    frame = spark.createDataFrame(rows, "doc_id long, base string, v string")
    hunks = R.diff_hunks(frame, "v")
    rebuilt = {r.doc_id: r.preview for r in R.apply_edits(frame, hunks).collect()}
    assert rebuilt == {i: variant for i, _, variant in rows}


def test_random_substitutions_against_a_plain_merge(spark):
    rng = random.Random(5)
    letters, others = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = []
    for i in range(60):
        base = "".join(rng.sample(letters, 20))
        places = rng.sample(range(0, 20, 2), 4)  # changes never touch
        a, b = list(base), list(base)
        for p in places[:2]:
            a[p] = others[p]
        for p in places[2:]:
            b[p] = others[p]
        rows.append((i, base, "".join(a), "".join(b)))
    frame = spark.createDataFrame(rows, "doc_id long, base string, a string, b string")
    got = {r.doc_id: (r.preview, r.conflicts) for r in R.reconcile(frame, levels=("char",)).collect()}
    assert got == {i: (merged_characters(base, a, b), 0) for i, base, a, b in rows}


def test_rows_that_share_an_id_are_merged_on_their_own(spark):
    rows = [(1, "the cat", "the dog", "the cat"), (1, "the cat", "the dog", "the cat"), (1, "x y", "x y", "x z"), (2, "p", "q", "p")]
    frame = spark.createDataFrame(rows, "doc_id long, base string, a string, b string")
    got = sorted((r.doc_id, r.preview, r.singletons) for r in R.reconcile(frame).collect())
    assert got == [(1, "the dog", 1), (1, "the dog", 1), (1, "x z", 1), (2, "q", 1)]


def naive_gaps(texts, levels):
    """Anchors by their definition, one token after the other."""
    found = [(texts, [0] * len(texts))]
    for level in levels:
        finer = []
        for parts, starts in found:
            words = [list(split(part, level)) for part in parts]
            places = [{w: sum(map(len, own[:i])) for i, w in enumerate(own)} for own in words]
            once = [w for w in words[0] if all(own.count(w) == 1 for own in words)]
            straight = [
                w for w in once
                if all((p[w] < p[o]) == (places[0][w] < places[0][o]) for p in places for o in once if o != w)
            ]
            done = [0] * len(parts)
            for word, at in [(w, [p[w] for p in places]) for w in straight] + [("", [len(p) for p in parts])]:
                inner = [part[f:t] for part, f, t in zip(parts, done, at)]
                if len(set(inner)) > 1:
                    finer.append((inner, [s + f for s, f in zip(starts, done)]))
                done = [p + len(word) for p in at]
        found = finer
    out = []
    for parts, starts in found:
        head = len(os.path.commonprefix(parts))
        ends = [part[head:][::-1] for part in parts]
        tail = len(os.path.commonprefix(ends))
        out.append([(s + head, part[head : len(part) - tail]) for part, s in zip(parts, starts)])
    return out


@pytest.mark.parametrize("sides", [2, 3])
def test_gaps_follow_the_definition(sides):
    rng = random.Random(sides)
    pieces = ["a", "b", "ab", " ", "  ", "\n", "é", "é", "漢", ".", "-", "\U0001f600", "x1", "\t", " "]
    for size in (0, 3, 12, 40, 120):
        for _ in range(60):
            base = [rng.choice(pieces) for _ in range(size)]
            texts = []
            for _ in range(sides):
                own = list(base)
                for _ in range(rng.randrange(4)):
                    i = rng.randrange(len(own) + 1)
                    own[i : i + rng.randrange(3)] = rng.choices(pieces, k=rng.randrange(3))
                texts.append("".join(own))
            for levels in (R.LEVELS, ("token",), ("char",)):
                assert list(gaps(texts, levels)) == naive_gaps(texts, levels), texts


def test_no_token_becomes_a_row(spark):
    frame = spark.createDataFrame(PAIR_ROWS, "doc_id long, base string, a string, b string")
    rows = R.merge_components(frame)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Generate" not in plan
    assert [r.original for r in rows.orderBy("start").collect()] == ["two", "four"]


def test_reconcile_rebuilds_documents_where_they_lie(spark):
    schema = "doc_id long, base string, a string, b string"
    frame = spark.createDataFrame([*PAIR_ROWS, (None, "one two", "1 two", "one 2"), (5, "kept", "new", None)], schema)
    rows = R.reconcile(frame)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan
    got = {r.doc_id: tuple(r)[1:] for r in rows.collect()}
    assert got == {
        1: ("one 2 three 4", 0, 2, 0), 2: (None, 0, 0, 0), 3: ("q", 0, 0, 0), None: ("1 2", 0, 2, 0), 5: ("kept", 0, 0, 0),
    }


def test_preview_and_counts_equal_those_of_the_components(spark):
    rng = random.Random(11)
    rows = []
    for i in range(200):
        base = [rng.choice(["one", "two", " ", "\n", "é", "漢", "x"]) for _ in range(40)]
        a, b = list(base), list(base)
        for own in (a, b):
            for _ in range(4):
                own[rng.randrange(40)] = rng.choice(["one", "new", "", "-"])
        rows.append((i, "".join(base), "".join(a), "".join(b)))
    frame = spark.createDataFrame(rows, "doc_id long, base string, a string, b string")
    components = R.merge_components(frame)
    edits = components.select("doc_id", "start", "end", F.col("merged").alias("replacement"))
    wanted = {r.doc_id: [r.preview, 0, 0, 0] for r in R.apply_edits(frame, edits).collect()}
    for r in components.collect():
        wanted[r.doc_id][("", "conflict", "singleton", "agreement").index(r.state)] += 1
    assert {r.doc_id: list(r)[1:] for r in R.reconcile(frame).collect()} == wanted


PAIR_ROWS = [(1, "one two three four", "one 2 three four", "one two three 4"), (2, None, "x", "y"), (3, "q", "q", "q")]


def test_gaps_of_numbered_tokens_equal_those_of_strings(monkeypatch):
    rng = random.Random(11)
    kinds = ["the", "of", "a", "\n", " ", "  ", ".", "\0", "eightbyt", "ninebytes", "ninebytez", "é", "𠀀", "甲乙丙", "x" * 30, "ǘ"]

    def changed(words):
        out = []
        for word in words:
            draw = rng.random()
            out += [] if draw < 0.05 else [rng.choice(kinds)] if draw < 0.1 else [word, f"new{rng.randrange(40)}"] if draw < 0.15 else [word]
        return out

    cases = []
    for n in range(300):
        words = [rng.choice([*kinds, f"w{rng.randrange(200)}", f"longer_word_{rng.randrange(50)}"]) for _ in range(rng.randrange(120))]
        sides = [words, *(changed(words) for _ in range(1 + n % 3))]
        if n % 5 == 0:
            rng.shuffle(sides[1])
        cases.append(["".join(side) for side in sides])
    by_place = [list(anchors._cut(c, [0] * len(c), anchors.anchors(c, "token"))) for c in cases]
    assert [[(list(p), list(s)) for p, s in anchors._token_gaps(c, [0] * len(c))] if all(c) else w for c, w in zip(cases, by_place)] == by_place
    monkeypatch.setattr(anchors, "_ARRAYS", 1)
    arrays = [list(gaps(c, R.LEVELS)) for c in cases]
    monkeypatch.setattr(anchors, "_ARRAYS", 1 << 60)
    assert [list(gaps(c, R.LEVELS)) for c in cases] == arrays
    for parts in cases:
        for c in (parts, [p[:40] for p in parts]):
            short = [(list(p), list(s)) for p, s in anchors._char_gaps(c, [3] * len(c))]
            assert short == list(anchors._cut(c, [3] * len(c), anchors.anchors(c, "char")))
