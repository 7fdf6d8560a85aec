"""Operators that judge or rewrite single texts: fertility, licenses, quality, language, extraction, tokens."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import bpe, crf, density, fertility, licenses, queries, ranking, words
from tests.llm.helpers import FOLDER, WORD, awkward, documents, folded

BYTE_BPE = queries.vocabulary("byte_bpe_50k.json")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# fertility


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_fertility_counts_equal_plain_ones(spark):
    rows = documents(spark) + [(r["doc_id"] + 10_000, r["text"]) for r in awkward(spark).collect()]
    got = by_id(queries.op1_tokeniser_fertility(spark, FOLDER)) | {
        i + 10_000: r for i, r in by_id(fertility.judge(awkward(spark), BYTE_BPE, queries.vocabulary("piece_bpe_32k.model"))).items()
    }
    for i, text in rows:
        r = got[i]
        counts = base_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])


def test_fertility_measures_equal_the_libraries(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    own = Tokenizer.from_file(BYTE_BPE)
    text = "Some plain words, 12 of them, and ✨ strange ☃ ones " * 3
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = fertility.judge(docs, BYTE_BPE, model_path()).first()
    words = WORD.findall(text)
    told = sum(c.isalnum() or ord(c) > 127 for w in words for c in w)
    pieces = [i for w in words for i in model.encode(w)]
    assert r["chars_per_token"] == pytest.approx(told / sum(len(own.encode(" " + w).ids) for w in words))
    assert r["chars_per_piece"] == pytest.approx(told / len(pieces))
    assert r["byte_share"] == pytest.approx(sum(map(model.is_byte, pieces)) / len(pieces))
    counts = np.array(list(Counter(pieces).values())) / len(pieces)
    assert r["relative_entropy"] == pytest.approx(-(counts * np.log2(counts)).sum() / np.log2(min(256, len(pieces))))
    assert r["band"] == "latin"


def test_fertility_counts_tokens_of_words_with_odd_space_as_the_library():
    own = Tokenizer.from_file(BYTE_BPE)
    plain = ["the", "a'sb", "don't", "'s", "x'", "12ab", "!!a", "é𠀀", "\x00", "☃☃", "Z" * 300, "'"]
    odd = ["a\xa0", "\xa0", "\u2003b", "\x85\x85", "c\u3000\xa0d", "\x1c"]
    for words_ in (plain, odd, odd + plain + odd):
        counts = fertility._byte_tokens(words_, bpe.codec(BYTE_BPE))
        assert counts.tolist() == [len(own.encode(" " + w).ids) for w in words_]


def test_fertility_learns_a_word_once_a_task():
    byte_level, (model, is_byte, _) = bpe.codec(BYTE_BPE), fertility.piece_model(model_path())

    class Counting:
        asked = 0

        def encode(self, given, **how):
            self.asked += len(given)
            return model.encode(given, **how)

    counting, made = Counting(), type(fertility.piece_model(model_path())[2][0])
    pieces, distinct = (counting, is_byte, [made(), made()]), 0
    for again in range(2):
        for part in range(3):
            texts = words.texts_of(pa.array([" ".join(f"{chr(97 + part)}{i}" for i in range(130_000))]))
            cut = words.words_of(texts)
            fertility.measures(texts, cut, words.word_hashes(texts, cut), byte_level, pieces)
            distinct += 0 if again else 130_000
    assert counting.asked == distinct


def model_path():
    return queries.vocabulary("piece_bpe_32k.model")


def test_fertility_rejects_junk_and_keeps_plain_texts(spark):
    got = queries.op1_tokeniser_fertility(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    rows = [r for r in got.collect() if not r["base_failed"] and r["quality"] is not None]
    assert all(r["kept"] for r in rows if r["quality"] == 1)


# licenses


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))
    found = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_equals_plain_search(spark):
    got = by_id(queries.op3_license_scan(spark, FOLDER)) | {r["doc_id"] + 10_000: r for r in licenses.scan(awkward(spark)).collect()}
    for i, text in documents(spark) + [(r["doc_id"] + 10_000, r["text"]) for r in awkward(spark).collect()]:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_places(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2"),
        ("GNU General Public License v3.0", "gpl-3"),
        ("GNU Lesser General Public License, version 2.1", "lgpl-2.1"),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"),
        ("BSD 3-Clause License", "bsd-3"),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"),
        ("Released\nunder the   MIT license", "mit"),
        ("the commits of a submitter", ""),
    ],
)
def test_license_signatures(text, labels):
    part = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    assert licenses._scan_slice(part).to_pylist()[0]["labels"] == labels


def test_license_rules_and_suppression():
    assert len(licenses.build_rules()) > 200
    inner, outer, apart = (5, 9, 60, "a"), (0, 10, 60, "b"), (8, 14, 10, "c")
    assert licenses.resolve([inner, outer, apart]) == [outer, apart]
    assert licenses.resolve([(5, 9, 90, "a"), outer]) == [outer, (5, 9, 90, "a")]  # the stronger one stays inside
    assert licenses.resolve([]) == []


def drawn(tree, rng):
    """A text that a parsed expression matches (look-arounds apart)."""
    from re import _constants as c

    out = ""
    for kind, value in tree:
        if kind is c.LITERAL:
            out += chr(value)
        elif kind is c.IN:
            first = rng.choice([v for v in value if v[0] in (c.LITERAL, c.RANGE, c.CATEGORY)])
            out += {c.LITERAL: lambda v: chr(v), c.RANGE: lambda v: chr(rng.randint(*v)), c.CATEGORY: lambda v: "w"}[first[0]](first[1])
        elif kind is c.MAX_REPEAT:
            out += "".join(drawn(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
        elif kind is c.SUBPATTERN:
            out += drawn(value[3], rng)
        elif kind is c.BRANCH:
            out += drawn(rng.choice(value[1]), rng)
        elif kind not in (c.ASSERT, c.ASSERT_NOT, c.AT):
            raise ValueError(kind)
    return out


WRAPPED = (
    "GNU General\nPublic License version 3", "European Union\nPublic License 1.2", "GNU Free\nDocumentation License 1.3", "in the public\ndomain",
    "Permission is hereby\ngranted, free of charge, to any person", "Expat License", "do what the fuck you want to public license",
    "beer-ware license", "Licence Ouverte", "CreativeML Open RAIL-M license", "under the terms of the\n GNU General Public License",
    "Creative\tCommons Attribution 4.0", "Redistribution and\nuse in source and\nbinary forms", "All rights\nreserved", "free to share\nand adapt",
    "permission to use, copy,\nmodify, and/or distribute this software", "open\ngovernment licence v3", "Lesser\nGeneral Public License 2.1",
)


def test_license_prefilter_loses_no_match():
    rng, known = random.Random(7), licenses.scanner()
    rules = [pattern for some in known.by_keyword.values() for pattern, _, _ in some]
    trees = [re._parser.parse(pattern.pattern.decode("latin-1")) for pattern in rules]
    texts = [*WRAPPED, *(drawn(tree, rng) for tree in trees for _ in range(8))]
    texts = [f"{a} {t} z" for a, t in zip("xy" * len(texts), texts, strict=False)]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found = licenses._scan_slice(part).to_pylist()
    for text, row in zip(texts, found, strict=True):
        every = known.detect(re.sub("[A-Z]", lambda m: m[0].lower(), text).encode(), known.by_keyword)
        assert [tuple(d.values()) for d in row["detections"]] == every, text
    assert all(row["detections"] for row in found[: len(WRAPPED)])


# quality


def test_quality_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op4_pairwise_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (8, 0), (9, 1), (3, None), (None, 1)], "doc_id long, quality int")
    model = ranking.train(docs, labels, held=9)
    got = Counter(r["doc_id"] for r in ranking.score(docs, model).collect())
    assert got == Counter(r["doc_id"] for r in docs.collect())
    assert {r["score"] for r in ranking.score(docs, model).where("doc_id in (4, 5, 6)").collect()} == {0.0}
    kept = ranking.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (4, 5, 6)").count() == 0
    nothing = ranking.train(docs, labels.limit(0))
    assert all(r["score"] == 0 or r["score"] == pytest.approx(0.3) for r in ranking.score(docs, nothing).collect())
    assert ranking.score(docs.limit(0), model).count() == 0


def test_ranking_orders_by_preference():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(400, len(ranking.FEATURES)))
    rows[:, ranking.FEATURES.index("log_words")] = 1
    better = rows[:, 0] + 0.1 * rng.normal(size=400) > -0.5
    model = ranking.fit(rows, better)
    assert ((model.scores(rows) >= ranking.CUT) == better).mean() > 0.93


# language


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    first = np.array([0, 1, 1, 300, 301, 700])
    scores, moves = 2 * rng.normal(size=(700, 3)), rng.normal(size=(3, 3))
    got = crf.marginals(scores, first, moves)
    step = np.exp(moves)
    for a, b in zip(first, first[1:], strict=False):
        weight, state, ahead, behind = np.exp(scores[a:b]), np.ones(3) / 3, [], [np.ones(3)]
        for w in weight:
            state = (state @ step) * w
            state /= state.sum()
            ahead.append(state)
        for w in weight[:0:-1]:
            v = step @ (w * behind[-1])
            behind.append(v / v.sum())
        if b > a:
            both = np.array(ahead) * np.array(behind[::-1])
            assert np.allclose(both / both.sum(axis=1, keepdims=True), got[a:b])


def test_slope_of_moves_is_that_of_the_likelihood():
    from itertools import product

    rng = np.random.default_rng(5)
    scores, moves = 2 * rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    first, gold = np.array([0, 5, 9]), rng.integers(0, 3, 9)
    ahead, behind, weight = crf.messages(scores, first, moves)
    both = ahead * behind
    assert np.allclose(both / both.sum(axis=1, keepdims=True), crf.marginals(scores, first, moves))

    def likelihood(moves):
        def path(a, x):
            inner = sum(scores[a + t, y] for t, y in enumerate(x)) + sum(moves[y, z] for y, z in zip(x, x[1:], strict=False))
            return inner + np.log(np.exp(moves[:, x[0]]).sum())

        spans = list(zip(first, first[1:], strict=False))
        return sum(path(a, gold[a:b]) - np.log(sum(np.exp(path(a, x)) for x in product(range(3), repeat=b - a))) for a, b in spans)

    got = crf.slope_of_moves(gold, ahead, behind, weight, first, moves)
    for i, j in product(range(3), repeat=2):
        up, down = moves.copy(), moves.copy()
        up[i, j] += 1e-5
        down[i, j] -= 1e-5
        assert got[i, j] == pytest.approx((likelihood(up) - likelihood(down)) / 2e-5, abs=1e-5)


def test_language_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = queries.op8_crf_language(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_every_language_is_learned(spark):
    rows = [(i, "the and of with that " * 3, "en") for i in range(3000)] + [(5000 + i, "der die und nicht ist " * 3, "de") for i in range(8)]
    rows += [(6000 + i, "le la les une dans " * 40, "fr") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = crf.sample(docs, 4, 2, 20, 500)
    sizes = Counter(lang for _, lang in found)
    assert set(sizes) == {"en", "de", "fr"} and len(found) == 20 and min(sizes.values()) >= 4
    assert all(0 < len(text) <= 500 and text.split()[-1] in "that ist le la les une dans".split() for text, _ in found)
    assert crf.sample(docs.union(docs), 4, 2, 20, 500) == found
    assert crf.train(docs, rows=20, chars=500).labels == ["de", "en", "fr"]
    assert len(crf.sample(docs, 4, 2, 2, 500)) == 3 and crf.train(docs.limit(0)).labels == []
    assert crf.shares({"a": 500, "b": 3, "c": 500}, 100) == {"b": 3, "a": 48, "c": 49}


def test_language_of_switching_and_awkward_texts(spark):
    field = crf.fit(["the and of with that " * 30, "der die und nicht ist " * 30, "le la les une dans " * 30], ["en", "de", "fr"])
    docs = spark.createDataFrame(
        [(1, "the and of with der die und nicht"), (2, None), (3, "12 !!"), (4, "der"), (4, "der")], "doc_id long, text string"
    )
    got = [(r["doc_id"], r["lang_pred"], [(s["start"], s["end"], s["lang"]) for s in r["spans"]]) for r in crf.label(docs, field).collect()]
    assert sorted(got)[0] == (1, "de", [(0, 4, "en"), (4, 8, "de")]) or sorted(got)[0] == (1, "en", [(0, 4, "en"), (4, 8, "de")])
    assert sorted(got)[1:3] == [(2, "und", []), (3, "und", [])]
    assert [g[1] for g in sorted(got)[3:]] == ["de", "de"]
    assert {r["lang_pred"] for r in crf.label(docs, crf.fit([], [])).collect()} == {"und"}
    assert crf.label(awkward(spark), field).count() == awkward(spark).count()
    assert crf.label(docs.limit(0), field).count() == 0


# extraction


def test_extraction_of_given_pages(spark):
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = queries.op9_text_density(spark, FOLDER).collect()
    assert len(got) == len(pages)
    for r in got:
        html = re.sub(r"<script>.*?</script>", "", pages[r["page_id"]], flags=re.S)
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])


ARTICLE = "<p>A long paragraph of the article, with many words in it.</p><p>Another &lt;one&gt;&nbsp;of them,<br>also long enough.</p>"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>", ""), ("<!-- <p>no</p>", ""),
        (f"<nav><a href=x>Home</a></nav><div class='content'>{ARTICLE}</div><footer>foot</footer>", "PAGE"),
        (f"<header><h1>Site</h1></header><main>{ARTICLE}<div class='comment-list'><p>reader words words words</p></div></main>", "PAGE"),
        (f"<script>var x='<p>no</p>'</script><div>{ARTICLE}</div><div id=cookie-banner>We use them</div><form><p>q</p></form>", "PAGE"),
        ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_extraction_cases(html, text):
    page = "A long paragraph of the article, with many words in it.\nAnother <one> of them, also long enough."
    assert density.main_text(html) == (page if text == "PAGE" else text)


@pytest.mark.parametrize(
    "html",
    [
        f"<body class='single no-sidebar'>{ARTICLE}</body>", f"<body class='post comments-open'><div>{ARTICLE}</div></body>",
        f"<body id=sidebar-left><main class=widget>{ARTICLE}</main></body>", f"<article class='post social-share'>{ARTICLE}</article>",
        f"<div class='content has-sidebar'>{ARTICLE}</div>", f"<div class='page-with-sidebar nav-open'>{ARTICLE}</div>",
        f"<div class='widget-area sidebar-wrap'><article>{ARTICLE}</article></div>", f"<main><div class='related'><article>{ARTICLE}</article></div></main>",
        f"<div class=banner><main><div class=share>Tell</div>{ARTICLE}</main></div><div class='sidebar'><p>Beside it</p></div>",
        f"<article>{ARTICLE}</article><section id=comments><article class=comment><p>Words of a reader</p></article></section>",
        f"<main>{ARTICLE}<div class=comments><article><p>Words of a reader</p></article></div></main>",
    ],
)
def test_extraction_of_pages_with_layout_names(html):
    assert density.main_text(html) == "A long paragraph of the article, with many words in it.\nAnother <one> of them, also long enough."


@pytest.mark.parametrize(
    "part",
    [
        '<h2 id="related-work">Own</h2>', '<section id="social-policy">Own</section>', '<p class="lead share-price">Own</p>', '<p class="commentary">Own</p>',
        '<section id="inadvertent-errors"><p>Own</p></section>', '<div class="commentary"><p>Own</p></div>', '<blockquote class="alert-level">Own</blockquote>',
        '<header class="banner"><h2>Own</h2></header>', '<ul><li class="search menu">Own</li></ul>', '<table class="notice"><tr><td class="ad">Own</td></tr></table>',
        '<figure class="promo"><figcaption class="share">Own</figcaption></figure>', '<pre class="alert">Own</pre>', '<h3 class="comments">Own</h3>',
    ],
)
def test_extraction_judges_no_text_by_its_name(part):
    text = "A long paragraph of the article, with many words in it.\nAnother <one> of them, also long enough."
    assert density.main_text(f"<body><article>{ARTICLE}{part}</article></body>") == f"{text}\nOwn"


@pytest.mark.parametrize("part", ["div id=related-posts", "div class=sitefooter", "ol class=commentlist", "aside id=x", "section id=comments", "div id=cookie-bar-2", "div class='page-ad slot'"])
def test_extraction_leaves_named_parts(part):
    text = "A long paragraph of the article, with many words in it.\nAnother <one> of them, also long enough."
    assert density.main_text(f"<body><article>{ARTICLE}<{part}><p>Of others</p></{part.split()[0]}></article></body>") == text


def test_extraction_keeps_titles_leads_and_short_sections():
    body = "".join(f"<p>{f'word{i} ' * 40}</p>" for i in range(5))
    text = "\n".join(" ".join([f"word{i}"] * 40) for i in range(5))
    inner = f"<h1>Short title</h1><p>{'lead ' * 40}</p><div>{body}</div><section><h2>Note</h2><p>Short words</p></section>"
    wanted = "\n".join(["Short title", " ".join(["lead"] * 40), text, "Note", "Short words"])
    links = "<ul><li><a href=x>Home</a></li><li><a href=y>Away</a></li></ul>"
    for page in (f"<article>{inner}</article>", f"<main>{inner}</main>", inner, f"<div>{links}<div>{inner}</div>{links}</div>"):
        assert density.main_text(f"<body>{page}</body>") == wanted
    assert density.main_text(f"<main><header><h1>Title</h1></header><div><h2>Sub</h2><article>{body}</article></div></main>") == f"Title\nSub\n{text}"
    twice = f"<main>{links}<article>{inner}</article><article><h2>Second</h2><p>Short too</p></article></main>"
    assert density.main_text(twice) == f"{wanted}\nSecond\nShort too"
    assert density.main_text(f"<body>Loose lead<div>{body}</div>{links}<p>End</p></body>") == f"Loose lead\n{text}\nHome\nAway\nEnd"


def test_extraction_keeps_every_row(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x</p>", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in density.extract(pages).collect()) == [(0, "x", 1), (1, "", 0), (1, "", 0)]
    assert density.extract(pages.limit(0)).count() == 0


# words


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = words.texts_of(pa.array(["one two  three", None, "", " x " * 50, "y" * 400 + " one"]))
    found = words.words_of(texts)
    whole = words.word_hashes(texts, found)
    for size in (1, 7, 100):
        monkeypatch.setattr(words, "HASH_BYTES", size)
        assert words.word_hashes(texts, found).tolist() == whole.tolist()
    assert whole[0] == whole[-1] and len(set(whole.tolist())) == 5
    assert not len(words.word_hashes(words.texts_of(pa.array([], pa.string())), words.words_of(words.texts_of(pa.array([], pa.string())))))


# tokens


def test_tokens_equal_the_library(spark):
    library = Tokenizer.from_file(BYTE_BPE)
    rows = documents(spark)
    got = by_id(queries.op10_bpe_round_trip(spark, FOLDER))
    for (i, text), ids in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        r = got[i]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids.ids), digest(",".join(map(str, ids.ids))))
        assert r["decoded_sha256"] == digest(library.decode(ids.ids, skip_special_tokens=False))


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b <|endoftext|>", "  \n\n x  ", "🎉🎉 naïve ﬁ 𠀀前'll'S  z", "a" * 5000, "ab" * 700 + "\x00\x7f", "q  w   e \n r\0 s", "a\x1cb \x85c​ ᠎d  e", " \n x  \n"])
def test_tokens_of_odd_texts(text):
    library, own = Tokenizer.from_file(BYTE_BPE), bpe.codec(BYTE_BPE)
    from palimpsest.llm.words import texts_of

    line, decoded, n = next(iter(own.encode_slice(texts_of(pa.array([text])))))
    ids = library.encode(text, add_special_tokens=False).ids
    assert line.decode() == ",".join(map(str, ids)) and n == len(ids)
    assert decoded.decode() == text == own.decode_line(line.decode())


def test_tokens_round_trip_awkward_rows(spark):
    docs = awkward(spark)
    ids = bpe.encode(docs, BYTE_BPE)
    assert ids.columns == ["doc_id", "ids"] and ids.count() == docs.count()
    back = bpe.decode(ids, BYTE_BPE)
    assert sorted((r[0], r[1]) for r in back.collect()) == sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert bpe.encode(docs.limit(0), BYTE_BPE).count() == 0


def test_speculation_and_merging_agree():
    own = bpe.codec(BYTE_BPE)
    words = [w.encode() for w in {"Thstinnt", " thndhain", "enkeit", " éèaux", "antidisestablishmentarianism", "x" * 60, "aaaaaaa"}]
    assert own.encode_pieces(words) == [own.merge(w) for w in words] == own.merge_all(words)


def test_a_codec_keeps_little_in_memory(monkeypatch):
    """Stretches and the trie lie in flat arrays, and stretches with one hash do not take each other's ids."""
    own = bpe.Codec(BYTE_BPE)
    arrays = [x for x in vars(own).values() if isinstance(x, np.ndarray)]
    assert sum(x.nbytes for x in arrays) < 8 << 20  # a dense table of the trie alone has 60 MB
    texts = [" ".join(f"w{i * 7919 % 100_003:x}{'é' * (i % 3)}" for i in range(n, n + 20_000)) for n in (0, 20_000, 0)]
    library = Tokenizer.from_file(BYTE_BPE)
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [own.encode_slice(words.texts_of(pa.array([t]))).ids().to_pylist()[0] for t in texts] == wanted
    parts = (own.known.hashes, own.known.place, own.known.count, *vars(own.known.line).values(), *vars(own.known.text).values())
    assert len(own.known) >= 40_000 and sum(x.nbytes for x in parts) < 100 * len(own.known)
    monkeypatch.setattr(bpe, "word_hashes", lambda texts, of: (of.end - of.start).astype(np.uint64))
    own.forget()
    for some in (["ab cd", "ef ab gh", ""], ["xy <|endoftext|> ab", "cd", None]):
        found = own.encode_slice(words.texts_of(pa.array(some, pa.string())))
        assert found.ids().to_pylist() == [library.encode(t or "", add_special_tokens=False).ids for t in some]
        assert [line.decode() for line, _, _ in found] == [",".join(map(str, x)) for x in found.ids().to_pylist()]
