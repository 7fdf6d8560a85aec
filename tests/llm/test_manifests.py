"""Merkle manifest, Golay fingerprints and source divergence against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from palimpsest.llm import divergence, golay, merkle, oracles, queries
from tests.llm.helpers import FOLDER, WORD, awkward, documents, folded


def both(frame, sql, table):
    """Rows of a query and of its SQL over the same arrow table, both sorted."""
    con = duckdb.connect()
    con.register("documents", table)
    found = con.sql(sql)
    columns = sorted(found.columns)
    assert sorted(frame.columns) == columns
    own = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    at = [found.columns.index(c) for c in columns]
    return own, sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root and witnesses (pairs of left and right digests) of a list of digests."""
    level, proofs, spans = list(leaves), [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, above_spans = [], []
        for at in range(0, len(level), 8):
            run = level[at : at + 8]
            for k in range(len(run)):
                for i in spans[at + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha(*run))
            above_spans.append([i for s in spans[at : at + 8] for i in s])
        level, spans = above, above_spans
    return level[0], proofs


def plain_manifest(rows):
    """(doc_id, leaf, tampered, subroot, root, proof, folded root) of (doc_id, text, lang, source, n_chars) rows."""
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        leaf = sha(*map(field, (doc_id, source, lang, n, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        low = None if text is None else folded(text)
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, sha(*map(field, (doc_id, source, lang, n, low))) if hit else leaf, doc_id))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: plain_tree([r[2] for r in sorted(groups[name])]) for name in names}
    root, tops = plain_tree([trees[name][0] for name in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        subroot, proofs = trees[name]
        for (_, _, leaf, at, doc_id), proof in zip(sorted(groups[name]), proofs, strict=True):
            path = [*proof, *top]
            for left, right in path:
                at = sha(left, at, right)
            out.append((doc_id, leaf, subroot, root, sha(*[x for p in path for x in p]), at, at == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def audited(docs):
    rows = merkle.audit(merkle.manifest(merkle.documents(docs), "lang", ["doc_id"], "leaf"))
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows.collect()), key=repr)


def test_manifest_equals_its_sql_and_a_plain_tree(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    own, sql = both(queries.op11_merkle_manifest(spark, FOLDER), oracles.OP11, table.toArrow())
    assert own == sql
    rows = [tuple(r) for r in table.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert audited(table) == plain_manifest(rows)
    assert 0 < sum(not r[6] for r in plain_manifest(rows)) < len(rows) / 2


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_blocks_of_any_size_give_the_same_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(levels)
    names = [None, "", "de", "é", "z"] + [f"l{i}" for i in range(12)]
    rows = [(i, f"Text {i}", "en", None, i) for i in range(700)]
    rows += [(rng.randrange(50), rng.choice(["A", "b", None, ""]), rng.choice(names), "s", None) for _ in range(300)]
    rows += [(None, "X", "en", "s", 1), (None, None, None, None, None), (7, "Copy", "en", "s", 1)] + [(7, "Copy", "en", "s", 1)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert audited(docs) == plain_manifest(rows)


def test_manifest_of_awkward_one_and_no_rows(spark):
    odd = awkward(spark).selectExpr("*", "doc_id AS n_chars", "'x' AS leaf", "'x' AS `~place`", "'x' AS witness")
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert audited(odd) == plain_manifest(rows)
    assert audited(odd.where("doc_id = 8")) == plain_manifest([r for r in rows if r[0] == 8])
    assert audited(odd.limit(0)) == []


def test_partial_witnesses_grow_with_later_siblings():
    tree = merkle.Appender(2)
    nodes = [tree.append(sha(str(i))) for i in range(10)]
    assert len(list(nodes[0].witness())) == 1 and list(nodes[9].witness()) == []
    root = tree.close().digest
    wanted, proofs = plain_tree([sha(str(i)) for i in range(10)])
    assert root == wanted and [list(n.witness()) for n in nodes] == proofs


# Golay fingerprints


def plain_fingerprint(text):
    words = WORD.findall(folded(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """(doc_id, fingerprint) -> sorted (doc_id, hex, smallest id reachable)."""
    marks = sorted({f for _, f in rows})
    parent = {f: f for f in marks}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(marks):
        for b in marks[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    least = {}
    for doc_id, f in rows:
        if doc_id is not None:
            least[find(f)] = min(least.get(find(f), doc_id), doc_id)
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=repr)


def test_code_is_perfect_and_neighbours_share_indices():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 23, 4000)
    words = golay.indices(values)
    code = np.arange(4096) << 11
    code ^= golay._remainder(code)
    distance = np.bitwise_count(values[:, None] ^ code[None, :])
    assert (distance.min(axis=1) <= 3).all() and (distance.argmin(axis=1) == words).all()
    sizes = {len(set(row)) for row in golay.near_indices(values, 23).tolist()}
    assert sizes == {1, 6}
    flipped = values ^ (1 << rng.integers(0, 23, 4000))
    assert all(h in row for h, row in zip(golay.indices(flipped), golay.near_indices(values, 23).tolist(), strict=True))


def test_components_of_fingerprints_equal_brute_force(spark):
    rows = [(i, plain_fingerprint(t)) for i, t in documents(spark)]
    got = queries.op12_golay_simhash(spark, FOLDER).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_components(rows)
    assert len({r["component_id"] for r in got}) < len(rows)


@pytest.mark.parametrize("bucket", [1, 64, 10**6])
def test_links_connect_all_fingerprints_within_two_bits(spark, monkeypatch, bucket):
    monkeypatch.setattr(golay, "BUCKET", bucket)
    rng = random.Random(8)
    marks = {rng.getrandbits(64) for _ in range(40)} | {0, 2**64 - 1}
    for f in list(marks):
        for _ in range(12):  # chains and clouds of one to three flipped bits
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
            marks.add(f)
    dense = rng.getrandbits(64)
    marks |= {dense ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(64)}
    signed = [f - (1 << 64) if f >> 63 else f for f in marks]
    found = golay.links(spark.createDataFrame([(f,) for f in signed], "fingerprint long"))
    pairs = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in found.collect()]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in pairs)
    from palimpsest.llm.components import components

    labels = {r["node"] & (2**64 - 1): r["label"] for r in components(found).collect()}
    ids = {f: i for i, f in enumerate(sorted(marks))}
    groups = defaultdict(list)
    for f in marks:
        groups[labels.get(f, (f,))].append(f)
    got = {frozenset(g) for g in groups.values()}
    wanted = defaultdict(set)
    for d, h, c in plain_components([(ids[f], f) for f in marks]):
        wanted[c].add(int(h, 16))
    assert got == {frozenset(g) for g in wanted.values()}


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(golay, "PART", 7)
    texts = ["a b", "one two  three four " * 30, None, "", "x\ty\nz", "É é " * 9]
    assert golay.fingerprint(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]


def test_fingerprints_of_awkward_rows(spark):
    odd = awkward(spark).selectExpr("*", "1 AS fingerprint", "1 AS label")
    extra = spark.createDataFrame([(None, "one"), (None, "of its own"), (0, None)], "doc_id long, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    got = golay.near_duplicates(docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_components(rows)
    assert golay.near_duplicates(docs.limit(0)).count() == 0


# source divergence


def plain_audit(rows):
    """The whole report of (text, lang, source) rows, from dictionaries."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded(text))) for text, lang, source in rows]
    seen, counts, groups = Counter(), Counter(), {(a, b) for a, b, _ in docs}
    for lang, source, terms in docs:
        seen.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    kept = defaultdict(list)
    for (lang, t), n in seen.items():
        if n >= 30:
            kept[lang].append(t)

    def shares(lang, of):
        n = {t: sum(counts[lang, s, t] for s in of) for t in kept[lang]}
        return {t: 1 + 10**9 * (c + 5) // (sum(n.values()) + 5 * len(n)) for t, c in n.items()}

    out = []
    for lang, source in groups:
        own = shares(lang, [source])
        others = [s for g, s in groups if g == lang]
        values = []
        for s in others:
            if s != source:
                p = shares(lang, [s])
                values.append((-sum(abs(own[t] - p[t]) for t in own), s))
        out += [(lang, source, "pair", s, -v, k) for k, (v, s) in enumerate(sorted(values, key=lambda x: (x[0], x[1].encode())), 1)]
        q = shares(lang, others)
        terms = sorted(((q[t] - own[t], t) for t in own if counts[lang, source, t] and own[t] > q[t]), key=lambda x: (x[0], x[1].encode()))
        out += [(lang, source, "term", t, -v, k) for k, (v, t) in enumerate(terms[:50], 1)]
    return sorted(out)


def test_divergence_equals_its_sql(spark):
    own, sql = both(queries.op13_source_divergence(spark, FOLDER), oracles.OP13, spark.read.parquet(f"{FOLDER}/documents.parquet").toArrow())
    assert own == sql and {r[2] for r in own} == {"pair", "term"}


def invented(rng, n):
    """Texts whose terms share beginnings and ends, of several scripts and lengths."""
    stems = ["a", "ab", "abc", "tion", "nation", "station", "é", "éa", "𠀀", "ß", "x" * 300] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(6)]
    rows = []
    for i in range(n):
        source = rng.choice([None, "", "a", "b", "é", "s" * 40])
        text = " ".join(rng.choice(stems[: 20 + 10 * (len(source or "") % 7)]).upper() if rng.random() < 0.3 else rng.choice(stems) for _ in range(rng.randrange(60)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice([None, "en", "de", "few"]) if i % 40 else "rare", source))
    return rows


@pytest.mark.parametrize(("most_bytes", "shard", "block"), [(10**9, 50_000, 128), (0, 50_000, 2), (10**9, 7, 1), (0, 5, 128)])
def test_divergence_by_broadcast_and_by_shards(spark, monkeypatch, most_bytes, shard, block):
    monkeypatch.setattr(divergence, "MOST_BYTES", most_bytes)
    monkeypatch.setattr(divergence, "SHARD_TERMS", shard)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", block)
    monkeypatch.setattr(divergence, "TERM_BLOCK", 2048 if block > 1 else 16)
    rows = invented(random.Random(shard), 600)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS ordinal", "'x' AS item", "1 AS v").repartition(4)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain_audit(rows)


def test_divergence_of_awkward_and_no_rows(spark):
    odd = awkward(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in divergence.audit(odd).collect()) == plain_audit(rows)
    assert divergence.audit(odd.limit(0)).count() == 0


def test_transducer_is_minimal_and_ranks_every_prefix():
    words = sorted({w.encode() for w in ["nation", "nations", "station", "stations", "ration", "a", "ab", "é"] + [f"{x}ing" for x in "abcdefgh"]})
    machine = divergence.transducer(words, range(len(words)))
    asked = [w[:k] for w in words for k in range(1, len(w) + 1)] + [b"zzz", b"nationss", b"ing"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    end = np.cumsum([len(w) for w in asked])
    got = divergence.Transducer.unpack(machine.pack()).ordinals_of(data, end - [len(w) for w in asked], end)
    assert got.tolist() == [words.index(w) if w in words else -1 for w in asked]
    # equal right languages are one state: the Myhill-Nerode classes of all prefixes
    rights = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in [b""] + [w[:k] for w in words for k in range(1, len(w) + 1)]}
    assert len(machine.final) - 1 == len(rights)


def test_bits_of_many_shingles_are_summed_in_small_parts():
    import tracemalloc

    text = pa.array([" ".join(str(i) for i in range(n, n + 20_000)) for n in range(0, 100_000, 20_000)])
    tracemalloc.start()
    try:
        golay.fingerprint(text)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 45_000_000  # all at once they take 74 MB
