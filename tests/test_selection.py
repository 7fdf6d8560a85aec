import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize
from palimpsest.operators import reconcile as R
from palimpsest.operators import review as V
from palimpsest.operators import selection as S

FAR = "".join(f"p{i} " for i in range(200))
NEAR = "".join(f" q{i}" for i in range(200))
#: four different words in one place; a wide change of the peer only; an insertion; a conflict amid long texts
TEXTS = [
    (1, "small boat sails", "small ship sails", "small raft sails", "small ferry sails"),
    (2, "red green blue end", "red green cyan end", "red green moss end", "red zzz end"),
    (3, "one two", "one big two", "one odd two", "one big two"),
    (4, f"{FAR}mid{NEAR}", f"{FAR}yes{NEAR}", f"{FAR}not{NEAR}", f"{FAR}mid{NEAR}"),
]


@pytest.fixture(scope="module")
def chain(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id long, base string, a string, b string, peer string")
    components = materialize(R.merge_components(texts))
    peer = materialize(R.diff_hunks(texts, "peer"))
    cases = materialize(S.conflict_cases(texts, components, peer))
    contexts = S.context_windows(texts, components, peer, cases)
    return texts, components, materialize(S.selection_cases(cases, contexts))


def test_candidates_versions_and_contexts(chain):
    rows = {r.doc_id: r for r in chain[2].collect()}
    assert {c.text for c in rows[1].candidates} == {"boat", "ship", "raft", "ferry"}
    assert {s for c in rows[2].candidates for s in c.sources} == {"base", "a", "b"}
    assert len(rows[3].candidates) == 3 and len(rows[3].versions) == 4
    for version in rows[4].versions:
        assert (len(version.before), len(version.after)) == (500, 500)
    for row in rows.values():
        by_id = {c.candidate_id: c.text for c in row.candidates}
        assert by_id[row.keep_candidate_id] == row.original
        assert all(by_id[v.candidate_id] == v.target for v in row.versions)


def test_packing(spark, chain):
    tight = S.budget_batches(chain[2], max_bytes=100).collect()
    assert [r.batch_no for r in tight] == [None] * 4
    rng = random.Random(5)
    rows, wanted = [], {}
    for doc in range(5):
        batch, pending = 1, []
        for i in range(40):
            size = rng.choice([5, 10, 20, 40, 60, 500])
            rows.append((doc, i, i + 1, f"case_{i}", size))
            if 12 + size > 100:
                wanted[doc, i] = None
                continue
            if len(pending) == 3 or 12 + sum(pending) + len(pending) + size > 100:
                batch, pending = batch + 1, []
            pending.append(size)
            wanted[doc, i] = batch
    frame = spark.createDataFrame(
        rows, "doc_id long, start long, end long, case_id string, bytes long"
    )
    packed = S.budget_batches(frame, max_cases=3, max_bytes=100).collect()
    assert {(r.doc_id, r.start): r.batch_no for r in packed} == wanted


@pytest.mark.parametrize("block_cases", [3, 7, 1024])
def test_packing_over_blocks_and_one_long_document(spark, block_cases):
    rng = random.Random(block_cases)
    rows, wanted = [], {}
    for doc, n in [(None, 5), (1, 1), (2, 6), (3, 7), (4, 400 if block_cases < 1024 else 100_000)]:
        batch, used, held = 1, 0, 0
        for i in range(n):
            size = rng.choice([1, 3, 9, 20, 30, 88, 89, 200])
            rows.append((doc, i * 50, i * 50 + 1, f"case_{i}", size))
            if size + 12 > 100:
                wanted[doc, i * 50] = None
                continue
            if used and (used == 3 or held + 1 + size + 12 > 100):
                batch, used, held = batch + 1, 0, 0
            held += size + (1 if used else 0)
            used += 1
            wanted[doc, i * 50] = batch
    frame = spark.createDataFrame(
        rows, "doc_id long, start long, end long, case_id string, bytes long"
    )
    packed = S.budget_batches(frame, max_cases=3, max_bytes=100, block_cases=block_cases).collect()
    assert len(packed) == len(rows)
    assert {(r.doc_id, r.start): r.batch_no for r in packed} == wanted


def test_packing_of_no_cases_and_repeated_rows(spark):
    schema = "doc_id long, start long, end long, case_id string, bytes long, extra string"
    assert S.budget_batches(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, 0, 1, "c", 40, "x")] * 5 + [(1, 2, 3, "d", None, "x")], schema)
    packed = S.budget_batches(twice, max_bytes=100).collect()
    assert sorted(r.batch_no for r in packed if r.case_id == "c") == [1, 1, 2, 2, 3]
    assert [r.batch_no for r in packed if r.case_id == "d"] == [None]


def test_decision_faults_reject_their_batch_only(spark):
    cases = spark.createDataFrame(
        [(1, f"b{b}", f"case_{c}", ["c1", "c2"]) for b in range(6) for c in range(2)],
        "doc_id long, batch_id string, case_id string, candidate_ids array<string>",
    )
    given = [(1, "b0", "case_0", "c1"), (1, "b0", "case_1", "c2"), (1, "b1", "case_0", "c1"),
             (1, "b2", "case_0", "c9"), (1, "b2", "case_1", "c1"), (1, "b3", "case_0", "c1"),
             (1, "b3", "case_1", "c1"), (1, "b3", "case_1", "c1"), (1, "b4", "case_0", "c1"),
             (1, "b4", "case_1", "c1"), (1, "b4", "case_7", "c1")]
    decisions = spark.createDataFrame(
        given, "doc_id long, batch_id string, case_id string, candidate_id string"
    )
    rows = {r.batch_id: r for r in S.decision_coverage(cases, decisions).collect()}
    assert [b for b, r in sorted(rows.items()) if r.valid] == ["b0"]
    assert (rows["b1"].missing, rows["b2"].unknown_candidate, rows["b3"].duplicated) == (1, 1, 1)
    assert (rows["b4"].unknown_case, rows["b5"].missing) == (1, 2)


def test_patches_reject_overlap_equal_starts_range_and_stale_text(spark):
    texts = spark.createDataFrame([(i, "abcdef") for i in range(6)], "doc_id long, base string")
    patches = spark.createDataFrame(
        [(0, 0, 1, "a", "X"), (0, 1, 2, "b", "Y"), (1, 0, 2, "ab", "X"), (1, 1, 3, "bc", "Y"),
         (2, 1, 1, "", "X"), (2, 1, 2, "b", "Y"), (3, 5, 9, "f", "X"), (4, 0, 1, "b", "X")],
        "doc_id long, start long, end long, original string, replacement string",
    )
    got = {r.doc_id: (r.outcome, r.text) for r in V.checked_patches(texts, patches).collect()}
    assert got == {0: ("applied", "XYcdef"), 1: ("overlap", None), 2: ("overlap", None),
                   3: ("out_of_range", None), 4: ("stale_original", None), 5: ("applied", "abcdef")}


def test_same_rows_with_other_partition_counts(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id long, base string, a string, b string, peer string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    first = sorted(map(tuple, R.reconcile(texts).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, R.reconcile(texts).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_hunk_categories(spark):
    marks, words = "prosodic_format_only", "lexical"
    pairs = [
        ("wait, here", "wait; here", marks), ("come in.", "come in!", marks), ("去吧", "去吧。", marks), ("so  far", "so far", marks),
        ("rev45", "rev4.5", words), ("north/south", "northsouth", words), ("re-enter", "reenter", words),
        ("Delta", "De,lta", words), ("Greenhouse", "Green house", words), ("one two", "one too", words),
    ]
    frame = spark.createDataFrame(
        [(i, a, b) for i, (a, b, _) in enumerate(pairs)], "doc_id long, base string, v string"
    )
    rows = R.classified_hunks(frame, R.diff_hunks(frame, "v"), "v").collect()
    assert {r.doc_id: r.category for r in rows} == {i: c for i, (_, _, c) in enumerate(pairs)}


def test_cases_of_one_pass_equal_those_of_stored_components(spark, chain):
    texts, components, full = chain
    ours = S.complete_cases(S.document_cases(texts))
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
    assert ours.count() == full.count() > 0
    assert ours.select(full.columns).exceptAll(full).isEmpty() and full.exceptAll(ours.select(full.columns)).isEmpty()


def test_components_and_cases_of_one_pass_equal_stored_ones(chain):
    texts, components, full = chain
    found = materialize(S.document_components(texts))
    parts = R.merge_states(found)
    assert parts.columns == components.columns and parts.exceptAll(components).isEmpty() and components.exceptAll(parts).isEmpty()
    cases = S.complete_cases(S.conflict_rows(found))
    wanted = full.drop("versions").select(cases.columns)
    assert cases.count() == full.count() and cases.exceptAll(wanted).isEmpty() and wanted.exceptAll(cases).isEmpty()


def test_request_bytes_without_contexts_equal_those_of_the_request(spark):
    odd = "".join(map(chr, range(128))) + "é€𠀀\u2028\x7f\x85"
    rng = random.Random(3)
    noise = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(700)))
    rows = [(i, *(f"{x}{w}{y}" for x, y in [(noise(), noise())] for w in ("one", "two", "six", p))) for i, p in enumerate(["one", "ten", "two", '"', "", "q"] * 5)]
    texts = spark.createDataFrame([*rows, (99, "old", "new", "red", None)], "doc_id long, base string, a string, b string, peer string")
    components = materialize(R.merge_components(texts))
    peer = materialize(R.diff_hunks(texts, "peer"))
    stored = S.conflict_cases(texts, components, peer)
    full = S.selection_cases(stored, S.context_windows(texts, components, peer, stored)).drop("versions")
    ours = S.complete_cases(S.conflict_rows(S.document_components(texts))).select(full.columns)
    assert ours.where("doc_id < 99").count() >= 30
    ours, full = ours.where("doc_id < 99"), full.where("doc_id < 99")
    assert ours.exceptAll(full).isEmpty() and full.exceptAll(ours).isEmpty()


@pytest.mark.parametrize("query", ["seal_gate", "selection_batch_audit"])
def test_documents_are_aligned_once(spark, tmp_path, monkeypatch, query):
    from palimpsest.plans import queries_selection as Q

    rows = [(i, f"{FAR}the boat {i} of the sea and {w} is of red{NEAR}") for i, w in enumerate(["sand", "the"] * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    passes = []

    def counted(*args, run=R.mapped_documents):
        passes.append(args)
        return run(*args)

    monkeypatch.setattr(R, "mapped_documents", counted)
    monkeypatch.setattr(S, "mapped_documents", counted)
    assert Q.QUERIES[query](spark, str(tmp_path)).count() >= 0
    assert len(passes) == 1


def test_audit_of_judged_cases_equals_the_audit_of_whole_ones(spark, chain):
    full = chain[2].withColumn("prompt", F.lit("p")).withColumn("prompt_sha256", F.when(F.col("doc_id") == 1, "sha256:0").otherwise(F.concat(F.lit("sha256:"), F.sha2("prompt", 256))))
    frozen = S.batch_ids(S.budget_batches(full)).drop("bytes").join(full, ["doc_id", "case_id", "start", "end"])
    frozen = frozen.withColumn("keep_candidate_id", F.when(F.col("doc_id") == 2, "c9").otherwise(F.col("keep_candidate_id")))
    frozen = materialize(frozen.withColumn("batch_id", F.when(F.col("doc_id") == 3, "x").otherwise(F.col("batch_id"))))
    judged = S.judged_cases(frozen).drop("candidates", "versions", "original")
    codes = {r.doc_id: r.codes for r in S.batch_audit(judged).collect()}
    assert codes == {r.doc_id: r.codes for r in S.batch_audit(frozen).collect()}
    assert codes == {1: ["prompt_hash"], 2: ["keep_not_original"], 3: ["batch_identity"]}
