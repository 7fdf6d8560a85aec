"""Keyed state of the streaming jobs: one row at a time, values, maps and timers kept by Spark's state store.

Every call to the state store costs more than a row, so keys share state by `shard`: a call serves what a shard got in
a batch or holds of a time slot. Rows of a shard come as an iterator, what must wait lies in map state by time slot, and
timers bring it back in order of event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators import rate_limit as RL

#: Rows of a shard that are put into state together.
TOGETHER = 20_000
#: Attempts of a shard wait, and are counted, in slots of this length.
SLOT_MS = 5 * 60 * 1000
#: Shards of a stream. They are part of its state: a stream started with one number goes on with it.
BUCKET_SHARDS = 1024
ONCE_SHARDS = 16_384
REUSE_SHARDS = PHONE_SHARDS = 4096
#: Early events wait in blocks of so many sequence numbers.
BLOCK = 1000

_OUTCOME = Row("bucket_key", "purpose", "event_id", "ts_ms", "outcome", "retry_after_s")
_ATTEMPT = ("bucket_key", "purpose", "event_id", "ts_ms")
_REUSE = Row("family_id", "reused_at")
_PROJECTED = Row("phone", "generation", "sequence", "ban_count", "status", "blocked_at", "last_ban_at", "outcome")


def shard(keys: list[str], shards: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int").alias("shard")


class Bucket(StatefulProcessor):
    """The rate limit of the buckets of a shard. Attempts wait until the watermark has passed them, so they count in
    order of time.

    State: window start, count and cooldown of every open window. It goes when the window is over, whatever its cooldown:
    the next attempt starts a new one. Attempts behind the watermark are given back as `late` and do not count.
    """

    def __init__(self, limit: int, bucket_type: str, purpose_type: str):
        self.limit = limit
        self.names = f"bucket_key array<{bucket_type}>, purpose array<{purpose_type}>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", f"{self.names}, started array<long>, used array<long>, cooldown array<long>")
        self.waiting = handle.getMapState("waiting", "slot long", f"{self.names}, event_id array<long>, ts_ms array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = (row for row in rows if row["event_id"] is not None)  # closing rows only move the watermark
        while part := list(islice(rows, TOGETHER)):
            arrived: dict[int, list[tuple]] = {}
            for row in part:
                bucket, purpose, event, ts = attempt = tuple(row[c] for c in _ATTEMPT)
                if ts < passed:
                    yield _OUTCOME(bucket, purpose, event, ts, "late", 0)
                else:
                    arrived.setdefault(ts // SLOT_MS, []).append(attempt)
            for slot, attempts in arrived.items():
                first = min(attempt[3] for attempt in attempts)
                held = self.waiting.getValue((slot,))
                if held is None or first < min(held[3]):
                    self.handle.registerTimer(first)
                self._wait(slot, [*(zip(*held) if held else ()), *attempts])

    def _wait(self, slot: int, attempts: list[tuple]) -> None:
        self.waiting.updateValue((slot,), tuple(map(list, zip(*attempts))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        state = self.window.get() if self.window.exists() else None
        windows = {(bucket, purpose): rest for bucket, purpose, *rest in zip(*state)} if state else {}
        slot = now // SLOT_MS
        held = self.waiting.getValue((slot,))
        if held is not None:
            attempts = sorted(zip(*held), key=lambda attempt: (attempt[3], attempt[2]))
            later = next((i for i, attempt in enumerate(attempts) if attempt[3] >= max(passed, now + 1)), len(attempts))
            if later < len(attempts):
                self._wait(slot, attempts[later:])
                self.handle.registerTimer(attempts[later][3])
            else:
                self.waiting.removeKey((slot,))
            for bucket, purpose, event, ts in attempts[:later]:
                outcome, wait = self._count(windows, (bucket, purpose), ts)
                yield _OUTCOME(bucket, purpose, event, ts, outcome, wait)
        # slots still to come may lie before the watermark, and their attempts in these windows
        over = now if self.waiting.exists() else max(now, passed)
        left = [(*names, *state) for names, state in windows.items() if over - state[0] < RL.WINDOW_MS]
        if left:
            self.window.update(tuple(map(list, zip(*left))))
            if over >= passed:
                self.handle.registerTimer(max(window[2] for window in left) + RL.WINDOW_MS)
        elif state:
            self.window.clear()

    def _count(self, windows: dict[tuple, list[int]], names: tuple, now: int) -> tuple[str, int]:
        """Outcome and wait of one attempt; its window is updated."""
        state = windows.get(names)
        if state is None or now - state[0] >= RL.WINDOW_MS:
            windows[names] = [now, 1, 0]
        elif now < state[2]:
            return "in_cooldown", max(1, -((now - state[2]) // 1000))
        else:
            state[1:] = state[1] + 1, 0
            if state[1] > self.limit:
                pause = RL.cooldown_ms(state[1] - self.limit)
                state[2] = now + pause
                return "cooldown_started", pause // 1000
        return "allowed", 0


class FirstReuse(StatefulProcessor):
    """The earliest use of a replaced token of every family of a shard; only families with such a use have state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "family_id array<long>, reused_at array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found: dict[int, int] = {}
        for row in rows:
            family, used, replaced = row["family_id"], row["used_at"], row["replaced_at"]
            if replaced is not None and used is not None and used >= replaced:
                found[family] = min(used, found.get(family, used))
        if not found:
            return
        known = dict(zip(*self.first.get())) if self.first.exists() else {}
        earlier = {family: used for family, used in found.items() if family not in known or used < known[family]}
        if earlier:
            known |= earlier
            self.first.update((list(known), list(known.values())))
            for family, used in earlier.items():
                yield _REUSE(family, used)


class Projection(StatefulProcessor):
    """Ban count and status of the generations of a shard's phones; events ahead of a gap wait in map state by block of
    their sequence. Rows that come together are taken by sequence, so only what is ahead of a gap then is held.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = "expected array<long>, ban_count array<long>, status array<string>, blocked_at array<long>, last_ban_at array<long>"
        self.state = handle.getValueState("state", f"phone array<long>, generation array<long>, {columns}")
        waits = "event_type array<string>, to_status array<string>, created_at array<long>"
        self.early = handle.getMapState(
            "early", "block long", f"phone array<long>, generation array<long>, sequence array<long>, {waits}"
        )

    def _block(self, loaded: dict, sequence: int) -> dict[tuple, tuple]:
        """Waiting events of a block: (phone, generation, sequence) -> event."""
        block = sequence // BLOCK
        if block not in loaded:
            held = self.early.getValue((block,))
            loaded[block] = {row[:3]: row[3:] for row in zip(*held)} if held else {}
        return loaded[block]

    def _store(self, loaded: dict, changed: set) -> None:
        for block in changed:
            if waiting := loaded[block]:
                self.early.updateValue((block,), tuple(map(list, zip(*[(*place, *event) for place, event in waiting.items()]))))
            else:
                self.early.removeKey((block,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.state.get() if self.state.exists() else None
        states = {(phone, generation): rest for phone, generation, *rest in zip(*kept)} if kept else {}
        touched = set()
        while part := list(islice(rows, TOGETHER)):
            loaded: dict[int, dict] = {}
            changed: set[int] = set()
            part.sort(key=lambda row: (row["sequence"], row["phone"], row["generation"]))
            for row in part:
                own, sequence = (row["phone"], row["generation"]), row["sequence"]
                event = (row["event_type"], row["to_status"], row["created_at"])
                touched.add(own)
                state = states.setdefault(own, [1, 0, "normal", None, None])
                place = (*own, sequence)
                held = self._block(loaded, sequence).get(place) if sequence >= state[0] else None
                if sequence < state[0] or (held is not None and held != event):
                    yield _PROJECTED(*own, sequence, None, None, None, None, "quarantined")
                    continue
                if sequence > state[0]:
                    if held is None:
                        self._block(loaded, sequence)[place] = event
                        changed.add(sequence // BLOCK)
                        yield _PROJECTED(*own, sequence, None, None, None, None, "held")
                    continue
                while event is not None:
                    self._apply(state, event)
                    event = self._block(loaded, state[0]).pop((*own, state[0]), None)
                    if event is not None:
                        changed.add(state[0] // BLOCK)
            self._store(loaded, changed)
        self.state.update(tuple(map(list, zip(*[(*own, *state) for own, state in states.items()]))))
        for own in touched:
            expected, *projected = states[own]
            yield _PROJECTED(*own, expected - 1, *projected, "projected")

    @staticmethod
    def _apply(state: list, event: tuple) -> None:
        kind, to_status, created = event
        state[0] += 1
        if kind == "qualifying_ban_applied":
            state[1], state[4] = state[1] + 1, created
        elif kind == "qualifying_ban_overturned":
            state[1] -= 1
        elif kind in ("phone_blocked", "phone_unblocked"):
            state[2], state[3] = to_status, created if to_status == "blocked" else None


class Once(StatefulProcessor):
    """The first row of a key as `unique`, rows behind the watermark as `late`; repeats are dropped.

    A key is forgotten when the watermark has passed the newest of its rows, so state follows the kept span of time. A
    shard's keys are read and written together, once for the rows of a batch.
    """

    def __init__(self, key: str, key_type: str, ms: str, keep_ms: int, columns: list[str]):
        self.key, self.key_type, self.ms, self.keep_ms = key, key_type, ms, keep_ms
        self.marked = Row(*columns, "outcome")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", f"key array<{self.key_type}>, ms array<long>")

    def _known(self) -> dict:
        return dict(zip(*self.newest.get())) if self.newest.exists() else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        first, changed = min(known.values(), default=None), False
        for row in rows:
            own, at = row[self.key], row[self.ms]
            if at is not None and at < passed:
                yield self.marked(*row[: len(self.marked) - 1], "late")
                continue
            newest = known.get(own)
            if newest is None:
                yield self.marked(*row[: len(self.marked) - 1], "unique")
            at = at if at is not None else passed + self.keep_ms
            if newest is None or at > newest:
                known[own], changed = at, True
        if changed:
            self.newest.update((list(known), list(known.values())))
            soon = min(known.values())
            if first is None or soon < first:
                self.handle.registerTimer(soon)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        known = self._known()
        left = {own: at for own, at in known.items() if at >= over}
        if left:
            if len(left) < len(known):
                self.newest.update((list(left), list(left.values())))
            self.handle.registerTimer(min(left.values()))
        elif known:
            self.newest.clear()
        return iter(())
