"""State of the streaming operators per key, for ``transformWithState``.

Values that Spark only keeps (events, orders) are stored as pickled bytes, so any
column types go; what a task holds is the state of one key's touched buckets.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RANK = {"update": 0, "insert": 1, "delete": 2}  # of one sequence value: an insert is not undone by its own update


def _order(value):
    """A comparable form of a value or struct (a dict here); nulls come first, as Spark sorts them."""
    if isinstance(value, dict):
        return tuple(_order(v) for v in value.values())
    return (True, value) if value is not None else (False,)


class FirstRow(StatefulProcessor):
    """The smallest row of the first batch of a key; the key is forgotten when event time
    has passed its last row by the watermark's delay."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.until.get()
        best, newest = None, known[0] if known else 0
        for row in rows:
            newest = max(newest, int(row["_t"].timestamp() * 1000) if row["_t"] is not None else 0)
            if known is None and (best is None or _order(row["_r"]) < _order(best)):
                best = row["_r"]
        if known is None or newest > known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.until.update((newest,))
            self.handle.registerTimer(newest)
        if best is not None:
            yield Row(**dict(zip(self.keys, key)), _r=best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        yield from ()


class ChangeLog(StatefulProcessor):
    """Inserts, increments and deletes of one key, in sequence order whatever the arrival.

    ``now``: the row after all events and the newest bucket. ``buckets``: for each bucket
    since the last delete its events and the row before them. ``floor``: the last
    delete; nothing up to it matters any more. With ``day`` (seconds of a bucket) buckets
    behind the watermark lose their events.
    """

    def __init__(self, day: int | None = None):
        self.day = day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "row binary")
        self.floor = handle.getValueState("floor", "at binary")
        self.buckets = handle.getMapState("buckets", "bucket long", "held binary")

    @staticmethod
    def _apply(row: tuple, events: list) -> tuple:
        present, value = row
        for _, rank, v in events:
            if rank == 2:
                present, value = False, None
            elif rank == 1 and not present:
                present, value = True, v
            elif rank == 0 and present and v is not None and value is not None:
                value += v
        return present, value

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.floor.get()
        floor = pickle.loads(bytes(stored[0])) if stored else None
        open_from = None                  # the first bucket that is not settled
        if self.day is not None:
            open_from = timerValues.getCurrentWatermarkInMs() // 1000 // self.day
        events = [(r["_b"], (_order(r["_s"]), RANK[r["_op"]], r["_v"])) for r in rows]
        events = [(b, e) for b, e in events
                  if (floor is None or e[0] > floor) and (open_from is None or b >= open_from)]
        stored = self.now.get()
        newest, now = pickle.loads(bytes(stored[0])) if stored else (None, (False, None))
        cleared = None                    # the bucket of a delete that came with this batch
        deletes = [(e[0], b) for b, e in events if e[1] == 2]
        if deletes:
            floor, cleared = max(deletes)
            self.floor.update((pickle.dumps(floor),))
            if newest is not None:
                for old in [k[0] for k in self.buckets.keys() if k[0] < cleared]:
                    self.buckets.removeKey((old,))
        fresh: dict[int, list] = {} if cleared is None else {cleared: []}
        for b, e in events:
            if floor is None or e[0] > floor:
                fresh.setdefault(b, []).append(e)
        todo = sorted(fresh)
        if todo and newest is not None and todo[0] < newest:   # late: every bucket from there on
            todo = sorted({k[0] for k in self.buckets.keys() if k[0] >= todo[0]} | set(todo))
        row = None                        # the row before the bucket, if it follows one just folded
        for b in todo:
            held = self._held(b) if newest is not None and b <= newest else None
            before, known = held or (None, [])
            if b == cleared:
                before, known = (False, None), [e for e in known if e[0] > floor]
            elif row is not None:
                before = row
            elif held is None:
                before = self._before_next(b) if newest is not None and b < newest else now
            known = sorted(known + fresh.get(b, []), key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0))
            self.buckets.updateValue((b,), (pickle.dumps((before, known)),))
            row = self._apply(before, known)
        if todo and (newest is None or todo[-1] >= newest):
            newest, now = todo[-1], row
            self.now.update((pickle.dumps((newest, now)),))
        if open_from is not None:
            self._settle(open_from, newest)
        yield Row(_k=key[0], value=now[1], present=now[0])

    def _held(self, bucket: int):
        found = self.buckets.getValue((bucket,))
        return pickle.loads(bytes(found[0])) if found is not None else None

    def _before_next(self, bucket: int) -> tuple:
        """The row before the first bucket after ``bucket`` is the row ``bucket`` starts from."""
        return self._held(min(k[0] for k in self.buckets.keys() if k[0] > bucket))[0]

    def _settle(self, settled: int, newest: int | None) -> None:
        for b in [k[0] for k in self.buckets.keys() if k[0] < settled and k[0] != newest]:
            self.buckets.removeKey((b,))
        if newest is not None and newest < settled and (held := self._held(newest)) is not None and held[1]:
            self.buckets.updateValue((newest,), (pickle.dumps((self._apply(*held), [])),))


class HoldSamples(StatefulProcessor):
    """Runs of ticks that show one sample, emitted as the watermark passes them (microseconds)."""

    def __init__(self, step: int):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "tick long, us long, value double")   # next tick, sample shown
        self.later = handle.getValueState("later", "rows binary")                      # samples not yet shown

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.later.get()
        later = pickle.loads(bytes(stored[0])) if stored else []
        best = {self._tick(o[0][1]): (o, v) for o, v in later}
        for row in rows:
            order = _order(row["_s"])
            tick = self._tick(row["_s"]["us"])
            if tick not in best or best[tick][0] < order:   # of one tick only the last sample shows
                best[tick] = (order, row["_v"])
        self.later.update((pickle.dumps(sorted(best.values(), key=lambda x: x[0])),))
        held = self.held.get()
        if held is None or held[1] < 0:                     # nothing shown yet
            first = min(best)
            self.held.update((first, -1, None))
            self._wake(first, timerValues)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        tick, us, value = self.held.get()
        stored = self.later.get()
        later = pickle.loads(bytes(stored[0])) if stored else []
        last = passed - passed % self.step                  # the last tick that is final
        rest = []
        for order, v in later:
            at = self._tick(order[0][1])
            if at > last:
                rest.append((order, v))
                continue
            if at > tick and us >= 0:
                yield self._run(key, tick, at - self.step, us, value)
            tick, us, value = max(tick, at), order[0][1], v
        if last >= tick and us >= 0:
            yield self._run(key, tick, last, us, value)
            tick = last + self.step
        self.held.update((tick, us, value))
        self.later.update((pickle.dumps(rest),))
        self._wake(tick, timerValues)

    @staticmethod
    def _run(key, first: int, last: int, us: int, value) -> Row:
        return Row(_k=key[0], first_tick=first, last_tick=last, sample_us=us, value=value)

    def _tick(self, us: int) -> int:
        return us + -us % self.step

    def _wake(self, tick: int, timerValues) -> None:
        self.handle.registerTimer(max(-(-tick // 1000), timerValues.getCurrentWatermarkInMs() + 1))


class Fallback(StatefulProcessor):
    """The readings of one poll until its deadline: the first of each source."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "held binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.first.get()
        if stored is None:
            self.handle.registerTimer(-(-key[0] // 1000))
        held = pickle.loads(bytes(stored[0])) if stored else {}
        for row in rows:
            order = _order(row["_s"])
            if row["p"] is not None and (row["p"] not in held or order < held[row["p"]][0]):
                held[row["p"]] = (order, row["a"], row["b"], row["whole"])
        self.first.update((pickle.dumps(held),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = pickle.loads(bytes(self.first.get()[0]))
        self.first.clear()
        source = min((p for p, r in held.items() if r[3]), default=None)
        a, b = held[source][1:3] if source is not None else (0.0, 0.0)
        yield Row(_k=key[0], source=source, a=a, b=b, ok=int(source is not None))
