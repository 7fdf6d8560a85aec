import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.hashing import hmac_sha256, length_prefixed
from palimpsest.operators import lineage as L
from palimpsest.operators import privacy as X
from palimpsest.operators import reputation as P
from palimpsest.operators import timeline
from palimpsest.operators import utterances as U
from palimpsest.operators import validation as V
from palimpsest.sources import store as S
from palimpsest.sources.references import is_usable_pdf, read_references
from palimpsest.sources.store import normal_path

UNITS = "doc_id long, pos long, text string, start_ms long, end_ms long"


def test_diagnostics_literal(spark):
    units = spark.createDataFrame(
        [(1, 0, "K", -5, 4), (1, 1, "", 3, 9), (1, 2, "LM", 12, 10), (1, 3, "\t", 10, 10), (2, 0, "no", 7, 8), (3, 0, "p", 0, 3), (3, 1, "q", 3, 6)], UNITS)
    inputs = spark.createDataFrame([(1, "KLM"), (2, ""), (3, "pq"), (4, "")], "doc_id long, audio_text string")
    rows = {r.doc_id: r for r in U.diagnostics(units, inputs).collect()}
    one = rows[1]
    assert (one.relation, one.input_length, one.output_length, one.length_delta, one.utterance_count) == ("differs", 3, 4, 1, 4)
    faults = ("empty_text_count", "negative_time_count", "reversed_interval_count", "zero_duration_count", "overlap_count")
    assert {f: one[f] for f in faults} == dict.fromkeys(faults, 1)
    assert (rows[2].relation, rows[2].length_delta) == ("differs", 2)
    assert [(rows[i].relation, rows[i].utterance_count) for i in (3, 4)] == [("identical", 2), ("identical", 0)]


def test_srt_literal_and_parts(spark):
    text = " first\r\nline "
    units = spark.createDataFrame(
        [(1, 0, text, 1200, 4380), (1, 1, "", 4380, 4380), (2, 0, "x", -1, 2), (3, 0, "x", 15, 12),
         (4, 0, "a", 0, 360_000_000), (4, 1, "b", 1, 2), (4, 2, "c", 2, 3)], UNITS)
    docs = spark.createDataFrame([(i,) for i in range(1, 6)], "doc_id long")
    got = {r.doc_id: (r.outcome, r.text) for r in U.render_srt(docs, units).collect()}
    assert got[1] == ("rendered", f"1\n00:00:01,200 --> 00:00:04,380\n{text}\n\n"
                                  "2\n00:00:04,380 --> 00:00:04,380\n\n")
    assert got[2] == got[3] == ("bad_time", None) and got[5] == ("rendered", "")
    parts = U.render_srt(docs, units, cues_per_part=2).where("doc_id = 4").orderBy("part").collect()
    assert len(parts) == 2 and "".join(p.text for p in parts) == got[4][1]
    assert got[4][1].startswith("1\n00:00:00,000 --> 100:00:00,000\na\n\n2\n")


def test_keywords_and_strict_json(spark):
    lists = [[" .NET ", "C++", "GPT-5.6", ".NET", "Ｓ＆Ｐ"], ["  "], [f"k{i}" for i in range(101)],
             ["C++"] * 101, ["　x\x1c"]]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<string>")
    rows = {r.i: r for r in V.normalize_keywords(frame, "v").collect()}
    assert rows[0].keywords == [".NET", "C++", "GPT-5.6", "Ｓ＆Ｐ"]
    assert [rows[i].outcome for i in range(5)] == ["ok", "blank", "too_many", "ok", "ok"]
    assert len(rows[2].keywords) == 101 and rows[1].keywords == [""]
    assert rows[3].keywords == ["C++"] and rows[4].keywords == ["x"]
    texts = ['{"x":NaN}', '{"x":Infinity}', '{"x":1,"x":2}', '{"x":1', '{"x":1}']
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(V.is_strict_json(F.col("t"))).collect()] == [False] * 4 + [True]


def test_hmac_and_length_prefix_equal_the_standard_library(spark):
    key = bytes(range(32))
    row = spark.createDataFrame([("+8613", "é")], "a string, b string").select(
        hmac_sha256(key, F.col("a")).alias("m"), length_prefixed(F.col("a"), F.col("b")).alias("p")
    ).first()
    assert bytes(row.m) == hmac.new(key, b"+8613", hashlib.sha256).digest()
    assert bytes(row.p) == b"\0\0\0\x05+8613\0\0\0\x02\xc3\xa9"


def test_redaction_keeps_diagnostic_names(spark):
    from urllib.parse import quote

    plain, odd = "open-sesame-77", 'va/ul+"t\\9'
    cut = "-" * 4093
    messages = [
        f"refused {plain} at gate; authorization: Basic Zm9v, next",
        f'X-Trace: 12 {{"service_api_key": \'k"1\'}} {quote(odd, safe="")} and {odd}',
        f"{cut}{plain}{cut}",
    ]
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, m string")
    rows = {r.i: r for r in X.redact(frame, "m", [plain, odd]).collect()}
    assert rows[0].body == "refused [REDACTED] at gate; authorization: [REDACTED], next"
    assert rows[1].body == 'X-Trace: 12 {"service_api_key": [REDACTED]} [REDACTED] and [REDACTED]'
    assert rows[2].body == f"{cut}[REDACTED]{cut}" and rows[2].excerpt_cut and rows[2].excerpt == f"{cut}[RE"


def test_paths_and_pdf(spark):
    frame = spark.createDataFrame([("/a/./b//c/../d",), ("/../x",)], "p string")
    assert [r[0] for r in frame.select(normal_path(F.col("p"))).collect()] == ["/a/b/d", "/x"]
    bodies = [b"%PDF-1" + b"x" * 5000 + b"%%EOF", b"x" * 1024 + b"%PDF-%%EOF", b"%PDF-/Encrypt%%EOF", b""]
    frame = spark.createDataFrame([(bytearray(b),) for b in bodies], "b binary")
    assert [r[0] for r in frame.select(is_usable_pdf(F.col("b"))).collect()] == [True, False, False, False]


def test_bans_block_at_three_and_again_after_unblock(spark):
    kinds = ["ban", "ban", "ban", "ban", "unblock", "unblock", "ban"]
    rows = [(1, 1, i, i * 10, i if i != 1 else 0, k) for i, k in enumerate(kinds)]
    frame = spark.createDataFrame(
        rows, "phone long, generation long, event_id long, ts_ms long, account long, kind string")
    got = {r.event_id: (r.ban_count, r.changes) for r in P.ban_outcomes(frame).collect()}
    # the second ban repeats account 0 and does not count
    assert got == {0: (1, False), 2: (2, False), 3: (3, True), 4: (None, True), 5: (None, False),
                   6: (4, True)}


def test_half_samples_round_away_from_zero(spark):
    frame = spark.createDataFrame([(1, 32_000), (-1, 32_000), (1, 32_001), (0, 5), (None, 5)],
                                  "n long, d long")
    frame = frame.select(*[F.col(c).cast("decimal(38,0)").alias(c) for c in frame.columns])
    got = [r[0] for r in frame.select(timeline.quantize(F.col("n"), F.col("d"), 16_000)).collect()]
    assert got == [1, -1, 0, 0, None]


def test_packets(spark):
    rows = [(1, 0, 0, 10), (1, 1, None, 10), (1, 2, 99, 10), (2, 0, 0, 10), (2, 1, 12, 10),
            (3, 0, 5, 10), (3, 1, 14, 10), (4, 0, 0, 10), (4, 1, 10, 10)]
    frame = spark.createDataFrame(rows, "stream_id long, ordinal long, pts long, duration long")
    got = {r.stream_id: (r.code, r.packet_ordinal, r.expected) for r in
           timeline.packet_continuity(frame, width=1).collect()}
    assert got == {1: ("timestamp_unavailable", 1, None), 2: ("gap", 1, 10),
                   3: ("backward_jump", 1, 15), 4: (None, None, None)}


@pytest.mark.parametrize(
    "text, clean",
    [
        ('signature="a\\"b" x', "signature=[REDACTED] x"),
        ("signature='a b' x", "signature=[REDACTED] x"),
        ("Authorization: Basic dXNlcg== x", "Authorization: [REDACTED] x"),
        ("authorization=bearer; tok,en", "authorization=[REDACTED],en"),
        ("my_api_key: k1; other", "my_api_key: [REDACTED]; other"),
        ("signature=[REDACTED] x", "signature=[REDACTED] x"),
        ("resignature=abc", "resignature=abc"),
        ('{"signature": "s", "n": 1}', '{"signature": [REDACTED], "n": 1}'),
    ],
)
def test_values_of_credential_names(spark, text, clean):
    frame = spark.createDataFrame([(1, text)], "i int, m string")
    assert X.redact(frame, "m", []).first().body == clean


def test_objects_are_stored_once_and_checked(spark, tmp_path):
    path = str(tmp_path / "objects")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "owner long, body string")
    S.write_objects(rows, "body", path, "owner")
    S.write_objects(rows, "body", path, "owner", S.read_objects(spark, path))
    found = S.read_objects(spark, path).collect()
    assert sorted(r.body for r in found) == ["a", "b"] and all(r.intact for r in found)
    forged = S.read_objects(spark, path).withColumn("body", F.concat("body", F.lit("!"))).drop("intact")
    forged.write.partitionBy("prefix").parquet(path + "-forged")
    assert not any(r.intact for r in S.read_objects(spark, path + "-forged").collect())


def test_reference_files_are_read(spark, tmp_path):
    for name, body in (("a.txt", b"text"), ("b.pdf", b"%PDF-1 body %%EOF")):
        (tmp_path / name).write_bytes(body)
    got = {r["name"]: bytes(r["content"]) for r in read_references(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": b"text", "b.pdf": b"%PDF-1 body %%EOF"}


def test_objects_that_escaped_keys_name_are_protected(spark):
    keys = ['a"b', "é/\\x", "plain"]
    transfers = spark.createDataFrame([(1, i, k, "persisted") for i, k in enumerate(keys)] + [(2, 9, "z", "persisted")], "run_id long, transfer_id long, object_key string, state string")
    import json

    bodies = [(1, json.dumps({"object_key": keys[0]})), (1, json.dumps({"x": [{"object_key": keys[1]}]})), (2, '{"object_key"')]
    runs = spark.createDataFrame([(1, "succeeded"), (2, "succeeded")], "run_id long, status string")
    got = {r.transfer_id: r.action for r in L.orphan_objects(transfers, spark.createDataFrame(bodies, "run_id long, body string"), runs).collect()}
    assert got == {0: "protected", 1: "protected", 2: "would_remove", 9: "unreadable"}


def test_unlisted_operations_keep_nothing(spark):
    prior = spark.createDataFrame([(1, "base_asr", "global", "x"), (2, "base_asr", "global", "y"), (3, "transcript", "global", "z")], "run_id long, stage string, scope string, artifact_id string")
    latest = spark.createDataFrame([(1, "unlisted", "global", "failed"), (2, "transcribe_peer", "global", "failed")], "run_id long, operation string, scope string, status string")
    runs = spark.createDataFrame([(1, "succeeded"), (2, "succeeded"), (3, "succeeded")], "run_id long, status string")
    missing = spark.createDataFrame([(3,)], "run_id long")
    kept = L.retry_carryover(prior, latest, runs, L.stage_closure(spark), L.operation_stages(spark), missing)
    assert sorted(r.run_id for r in kept.collect()) == [2, 3]
    assert [r.operation for r in L.unknown_operations(latest, L.operation_stages(spark)).collect()] == ["unlisted"]


def test_events_of_one_sequence_count_by_event_id(spark):
    schema = "phone long, generation long, sequence long, event_id long, event_type string, delta long, to_status string, created_at long"
    rows = [
        (1, 1, 4, 41, "phone_blocked", None, "blocked", 100), (1, 1, 4, 57, "phone_unblocked", None, "normal", 200),
        (1, 1, 3, 39, "qualifying_ban_applied", 1, None, 90), (1, 1, 3, 40, "qualifying_ban_applied", 1, None, 95),
    ]
    for order in (rows, rows[::-1]):
        got = P.replay(spark.createDataFrame(order, schema).coalesce(1)).first()
        assert (got["ban_count"], got["status"], got["blocked_at"], got["last_ban_at"]) == (2, "normal", None, 95)


def test_audit_walks_by_sequence_not_by_command(spark):
    schema = (
        "phone long, generation long, command_id long, event_id long, created_at long, stream string, event_type string,"
        " delta long, target_id long, from_status string, to_status string, sequence long"
    )
    far = 3 * P.WIDTH  # the earlier event has the command of a later slice
    rows = [
        (1, 1, far, 1, 1, "status", "generation_started", None, None, None, "normal", 1),
        (1, 1, far, 2, 2, "status", "phone_blocked", None, None, "normal", "blocked", 2),
        (1, 1, 5, 3, 3, "status", "phone_unblocked", None, None, "blocked", "normal", 3),
    ]
    stored = spark.createDataFrame(
        [(1, 1, 0, "normal", None, None)],
        "phone long, current_generation long, ban_count long, status string, blocked_at long, last_ban_at long",
    )
    assert P.audit(spark.createDataFrame(rows, schema), stored).collect() == []


def test_upsert_shuffles_rows_once_by_id_and_once_by_content(spark):
    """Unknown contents, several contents of one id, repeated rows; and few exchanges."""
    columns = "run_id long, artifact_id long, kind string, content_hash string"
    stored = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", None), (1, 3, "b", "z"), (2, 1, "a", "y")], columns)
    new = [
        (1, 1, "a", "x"), (1, 2, "a", "q"), (1, 3, "b", "w"), (1, 4, "a", "x"), (1, 5, "b", "x"), (1, 6, "b", "x"), (1, 6, "b", "x"),
        (1, 7, "a", "m"), (1, 7, "a", "n"), (1, 8, "a", None), (1, 9, "a", None), (1, 10, None, "x"), (2, 2, "a", "x"), (2, 3, "a", "y"),
    ]
    found = L.artifact_upsert(stored, spark.createDataFrame(new, columns))
    wanted = "unchanged collision collision duplicate_content inserted duplicate_content collision inserted inserted inserted"
    assert [r.outcome for r in found.where("run_id = 1").orderBy("artifact_id").collect()] == wanted.split()
    assert [r.outcome for r in found.where("run_id = 2").orderBy("artifact_id").collect()] == ["inserted", "duplicate_content"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
