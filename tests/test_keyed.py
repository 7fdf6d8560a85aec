"""Keyed state without a cluster: outcomes, and how often the state store is asked."""

import random

import pytest

from palimpsest.streaming import keyed


class Store:
    """State of one shard; counts the calls that cost a round trip."""

    def __init__(self):
        self.calls, self.timers, self.values, self.maps = 0, set(), {}, {}

    def getValueState(self, name, schema):
        return Value(self, self.values, name)

    def getMapState(self, name, key, value):
        return Map(self, self.maps.setdefault(name, {}))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Value:
    def __init__(self, store, values, name):
        self.store, self.values, self.name = store, values, name

    def exists(self):
        self.store.calls += 1
        return self.name in self.values

    def get(self):
        self.store.calls += 1
        return self.values.get(self.name)

    def update(self, value):
        self.store.calls += 1
        self.values[self.name] = value

    def clear(self):
        self.store.calls += 1
        self.values.pop(self.name, None)


class Map:
    def __init__(self, store, rows):
        self.store, self.rows = store, rows

    def exists(self):
        self.store.calls += 1
        return bool(self.rows)

    def getValue(self, key):
        self.store.calls += 1
        return self.rows.get(key)

    def containsKey(self, key):
        self.store.calls += 1
        return key in self.rows

    def updateValue(self, key, value):
        self.store.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.store.calls += 1
        self.rows.pop(key, None)


class Timers:
    def __init__(self, watermark, now=None):
        self.watermark, self.now = watermark, now

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.now


def run(processor, batches):
    """Rows of every batch with its watermark, then the timers behind the watermark in order."""
    store, out = Store(), []
    processor.init(store)
    for watermark, rows in batches:
        if rows:
            out += processor.handleInputRows((0,), iter(rows), Timers(watermark))
        while due := [at for at in store.timers if at < watermark]:
            store.timers.remove(min(due))
            out += processor.handleExpiredTimer((0,), Timers(watermark), Timers(watermark, min(due)))
    return out, store


@pytest.mark.parametrize("cut", [1, 4])
def test_attempts_of_many_buckets_ask_the_store_by_slot(cut):
    from test_streams import replay

    rng = random.Random(cut)
    rows = [
        keyed.Row(bucket_key=rng.randrange(200) if i % 2 else 7, purpose="x", event_id=i, ts_ms=rng.randrange(4_000_000))
        for i in range(4000)
    ]
    rows.sort(key=lambda r: r.ts_ms)
    size, batches, watermark = len(rows) // cut, [], 0
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        batches.append((watermark, rng.sample(part, len(part))))
        watermark = part[-1].ts_ms
    out, store = run(keyed.Bucket(3, "bigint", "string"), [*batches, (watermark, []), (10**12, [])])
    assert {r.event_id: r.outcome for r in out} == replay([(r.bucket_key, r.event_id, r.ts_ms) for r in rows], 3)
    assert len(out) == len(rows) and not store.values and not store.maps["waiting"]
    assert store.calls < len(rows) / 10


def test_keys_of_a_shard_ask_the_store_once_a_batch():
    rows = [keyed.Row(event_id=i % 900, ms=1000 + i) for i in range(1000)]
    late = [keyed.Row(event_id=450, ms=1), keyed.Row(event_id=450, ms=1500), keyed.Row(event_id=1200, ms=1800), keyed.Row(event_id=1200, ms=None)]
    out, store = run(keyed.Once("event_id", "bigint", "ms", 500, ["event_id", "ms"]), [(0, rows), (1499, []), (1499, late)])
    assert sorted(r.event_id for r in out if r.outcome == "unique") == sorted([*range(900), 450, 1200])
    assert [(r.event_id, r.ms) for r in out if r.outcome == "late"] == [(450, 1)]
    kept = {**{i % 900: 1000 + i for i in range(1000) if i >= 499}, 450: 1500, 1200: 1999}
    assert dict(zip(*store.values["newest"])) == kept
    assert store.calls < 20


def test_families_of_a_shard_ask_the_store_once_a_batch():
    first = [keyed.Row(family_id=i % 300, used_at=1000 - i, replaced_at=50) for i in range(600)]
    more = [keyed.Row(family_id=4, used_at=60, replaced_at=50), keyed.Row(family_id=5, used_at=999, replaced_at=50), keyed.Row(family_id=6, used_at=1, replaced_at=50)]
    out, store = run(keyed.FirstReuse(), [(0, first), (0, more)])
    assert sorted(map(tuple, out)) == sorted([*[(f, 700 - f) for f in range(300)], (4, 60)])
    assert store.calls < 10


def test_events_of_many_phones_ask_the_store_once_a_batch():
    ban = ("qualifying_ban_applied", None)
    fields = ("phone", "generation", "sequence", "event_type", "to_status", "created_at")
    rows = [keyed.Row(*fields)(p, 1, s, *ban, s) for p in range(50) for s in range(1, 41)]
    random.Random(2).shuffle(rows)
    again = [keyed.Row(*fields)(3, 1, 7, *ban, 7), keyed.Row(*fields)(3, 1, 42, *ban, 9), keyed.Row(*fields)(3, 1, 42, *ban, 8)]
    out, store = run(keyed.Projection(), [(0, rows[:700]), (0, rows[700:1400]), (0, rows[1400:]), (0, again)])
    last = {r.phone: (r.sequence, r.ban_count, r.last_ban_at) for r in out if r.outcome == "projected"}
    assert last == {p: (40, 40, 40) for p in range(50)}
    assert [(r.phone, r.sequence) for r in out if r.outcome == "quarantined"] == [(3, 7), (3, 42)]
    assert store.calls < 40 and store.maps["early"] == {(0,): ([3], [1], [42], [ban[0]], [None], [9])}
