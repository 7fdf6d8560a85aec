"""Calls with a ledger: killed runs, repeated runs, tasks tried again."""

import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import infer


def recorder(folder, dies_at=None):
    """A function that notes its calls as files; it dies in the middle of a batch, after the calls before."""

    def answer(batch):
        for key, attempt in zip(batch["idempotency_key"], batch["attempt"], strict=True):
            if key == dies_at:
                raise RuntimeError("killed")
            open(f"{folder}/{key}.{attempt}.{uuid.uuid4().hex}", "w").close()
        number = batch["idempotency_key"].str.slice(1).astype(int)
        good = (number % 5 != 0) | ((batch["attempt"] == 2) & (number % 10 != 0))
        return batch.assign(response=good.map({True: "{}", False: "not json"}), delivery="completed")

    return answer


def calls(folder):
    return Counter(tuple(name.split(".")[:2]) for name in os.listdir(folder))


def test_a_killed_run_replays_nothing_unclear(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    root = str(tmp_path / "ledger")
    requests = spark.createDataFrame([(f"k{i}", "p") for i in range(40)], "idempotency_key string, prompt string")
    settled = spark.createDataFrame([("k1", "succeeded"), ("k2", "delivery_ambiguous"), ("k3", "explicit_failure")], "idempotency_key string, status string")

    def run(dies_at=None):
        rows = infer.batch_infer(requests, settled, recorder(str(folder), dies_at), lambda r: F.try_parse_json(r).isNotNull(), root)
        return {(r.idempotency_key, r.attempt): r.status for r in rows.collect()}

    with pytest.raises(Exception, match="killed"):
        run("k17")
    assert infer.Ledger(spark, root).intents().count() == 38
    done = {(r.idempotency_key, r.attempt) for r in infer.Ledger(spark, root).attempts().collect()}
    before = calls(folder)
    assert ("k17", 1) not in done and ("k17", "1") not in before

    rows = run()
    after = calls(folder)
    assert set(before.values()) | set(after.values()) == {1}  # nothing is called twice
    fresh = {k for k in after if k not in before}
    assert all(attempt == "2" for _, attempt in fresh)  # only invalid answers are asked for again
    assert rows["k17", 1] == "delivery_ambiguous" and all(k not in ("k1", "k2") for k, _ in rows)
    lost = {k for k, status in rows.items() if status == "delivery_ambiguous"}
    assert lost == {(f"k{i}", 1) for i in range(40) if i not in (1, 2)} - done
    for key, attempt in done:
        if int(key[1:]) % 5 == 0:
            assert rows[key, 1] == "invalid_response" and rows[key, 2] == ("succeeded" if int(key[1:]) % 10 else "invalid_response")

    assert run() == rows and calls(folder) == after  # a third run calls nothing


def test_a_task_tried_again_calls_nothing(monkeypatch):
    import pandas as pd

    class Context:
        def __init__(self, n):
            self.n = n

        def attemptNumber(self):
            return self.n

    batch = pd.DataFrame({"idempotency_key": ["a"], "prompt": ["p"], "attempt": [1]})
    told = []

    def function(rows):
        told.append(len(rows))
        return rows.assign(response="{}", delivery="completed")

    for n, delivery in ((0, "completed"), (1, "ambiguous")):
        monkeypatch.setattr(infer.TaskContext, "get", staticmethod(lambda n=n: Context(n)))
        assert [list(x["delivery"]) for x in infer._call(function)([batch])] == [[delivery]]
    assert told == [1]


def test_no_requests(spark, tmp_path):
    none = spark.createDataFrame([], "idempotency_key string, prompt string")
    ledger = spark.createDataFrame([], "idempotency_key string, status string")
    assert infer.batch_infer(none, ledger, lambda b: b, lambda r: r.isNotNull(), str(tmp_path / "l")).count() == 0
