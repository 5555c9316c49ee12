"""The time check on streams whose rows arrive out of order: state with a waiting list, timers and expiry.

Every key keeps three things between micro-batches: the newest row put in order (it waits for its successor), the rows
that may still be overtaken, and the time at which it ends. A row leaves the list once the key has seen a time `delay` later, so rows
that are late by less take their place in order and the result equals the check of the whole table. A row older than what
its key has already put out is handed on with a reason. When the watermark passes a key's last row by `idle`, a timer puts
out what waits, the last row included, and the key's state is removed; a key that comes back starts anew.

Keys are dealt to a fixed number of buckets by hash, and a bucket's keys are one state, worked on together as arrays: a key's own
state cost some 35 ms a micro-batch, mostly calls. Keys do not see each other. The number of buckets belongs to a query's checkpoint.

Spark itself drops rows that are behind the watermark of the whole stream (counted in the progress of the query), so give
the watermark more grace than `delay`. Needs `spark.sql.streaming.stateStore.providerClass` set to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streamloom.columns import col
from streamloom.operators.checks import TimeCheck
from streamloom.streaming.checks import (
    BIG,
    DUPLICATE,
    LATE,
    REASON_LATE,
    REASON_NO_TIME,
    _from_bytes,
    _to_bytes,
)

#: Value of LATE: the last row of a key whose stream has ended.
REASON_ENDED = "end of stream"
PROVIDER = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


#: Buckets that share the keys; a bucket's waiting rows are in one task's memory.
BUCKETS = 256
# Spark renames columns of a processor's rows that begin with an underscore, so the key's text has none.
_TASK, _SEEN, _LAST, _ELAPSED, _FLAG, _REST = "task", "__seen", "__last", "__elapsed", "__flag", "__rest"
_NEVER = np.iinfo(np.int64).min


class _TimeSteps(StatefulProcessor):
    def __init__(self, names, time, event_time, ties, dt, limit, delay_s, idle_ms):
        self.names, self.time, self.event_time = names, time, event_time
        self.order, self.dt, self.limit = [time, *ties], dt, limit
        self.delay_s, self.idle_ms = delay_s, idle_ms
        self.output = [*names, dt, DUPLICATE, BIG, LATE]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getValueState("heads", "rows binary")
        self.tasks = handle.getValueState("tasks", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        heads, tasks = _kept(self.heads), _kept(self.tasks)
        known = [] if tasks is None else [tasks]
        for frame in rows:
            frame = frame[self.names].reset_index(drop=True)
            frame[self.time] = frame[self.time].astype(float)
            t = frame[self.time].to_numpy()
            reason = np.where(np.isnan(t), REASON_NO_TIME, None)
            if heads is not None:
                front = frame[_TASK].map(heads.set_index(_TASK)[self.time]).to_numpy(dtype=float)
                reason[t < front] = REASON_LATE
            aside = pd.notna(reason)
            if aside.any():
                yield self._bare(frame[aside], reason[aside])
            if not aside.all():
                self.waiting.appendValue((_to_bytes(frame[~aside]),))
            at = frame[self.event_time]
            last = np.where(at.isna(), _NEVER, at.to_numpy(dtype="datetime64[ms]").astype(np.int64))
            known.append(pd.DataFrame({_TASK: frame[_TASK], _SEEN: np.where(aside, -np.inf, t), _LAST: last}))
        tasks = pd.concat(known, ignore_index=True).groupby(_TASK, sort=False, as_index=False).max()
        heads = yield from self._advance(heads, tasks.set_index(_TASK)[_SEEN] - self.delay_s)
        self._keep(heads, tasks)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        heads, tasks = _kept(self.heads), _kept(self.tasks)
        if tasks is None:
            return
        last = tasks[_LAST].to_numpy()
        ends = np.where(last == _NEVER, np.iinfo(np.int64).max, last + self.idle_ms)
        ended = (ends <= expiredTimerInfo.getExpiryTimeInMs()) | (ends < timerValues.getCurrentWatermarkInMs())
        until = pd.Series(np.where(ended, np.inf, -np.inf), index=tasks[_TASK])
        heads = yield from self._advance(heads, until)
        if heads is not None:
            gone = heads[_TASK].isin(tasks[_TASK][ended]).to_numpy()
            if gone.any():
                yield self._bare(heads.loc[gone, self.names], np.full(gone.sum(), REASON_ENDED, object))
            heads = heads[~gone]
        self._keep(heads, tasks[~ended])

    def _keep(self, heads: pd.DataFrame | None, tasks: pd.DataFrame) -> None:
        """Stores heads and tasks; one timer stands for the task that ends first."""
        for state, table in ((self.heads, heads), (self.tasks, tasks)):
            if table is None or table.empty:
                state.clear()
            else:
                state.update((_to_bytes(table),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = tasks[_LAST][tasks[_LAST] != _NEVER]
        if len(last):
            self.handle.registerTimer(int(last.min()) + self.idle_ms)

    def _advance(self, heads: pd.DataFrame | None, until: pd.Series) -> Iterator[pd.DataFrame]:
        """Puts the waiting rows of every task up to its `until` in order behind its head; returns the new heads."""
        if not self.waiting.exists():
            return heads
        held = pd.concat([_from_bytes(r[0]) for r in self.waiting.get()], ignore_index=True)
        ready = held[self.time].to_numpy() <= held[_TASK].map(until).to_numpy(dtype=float)
        if not ready.any():
            return heads
        emit, heads = self._rebuilt(held[ready], heads)
        if ready.all():
            self.waiting.clear()
        else:
            self.waiting.put([(_to_bytes(held[~ready]),)])
        if len(emit):
            yield emit.assign(**{LATE: None})[self.output]
        return heads

    def _rebuilt(self, rows: pd.DataFrame, heads: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
        """`rebuild_rows` for many tasks at once: the rows that have a step, and the newest row of every task."""
        data, others = rows.assign(**{_ELAPSED: 0.0, _FLAG: False, _REST: True}), []
        if heads is not None:
            mine = heads[_TASK].isin(rows[_TASK]).to_numpy()
            others = [heads[~mine]] if not mine.all() else []
            if mine.any():
                data = pd.concat([heads[mine].assign(**{_REST: False}), data], ignore_index=True)
        data["__code"] = pd.factorize(data[_TASK])[0]
        data = data.sort_values(["__code", _REST, *self.order], kind="stable").reset_index(drop=True)
        code, t = data["__code"].to_numpy(), data[self.time].to_numpy(dtype=float)
        last = np.append(code[1:] != code[:-1], True)
        starts = np.flatnonzero(np.append(True, last[:-1]))
        step = np.where(last, np.nan, np.append(np.diff(t), np.nan))
        equal = ~last & np.append(t[1:] == t[:-1], False)
        same = equal | np.append(False, equal[:-1]) | data[_FLAG].to_numpy(dtype=bool)
        task = np.cumsum(np.append(True, last[:-1])) - 1
        before = data[_ELAPSED].to_numpy(dtype=float)[starts]
        kept = step > 0
        steps, owner = step[kept], task[kept]
        rebuilt = before[owner] + pd.Series(steps).groupby(owner).cumsum().to_numpy() - steps
        big = np.zeros(len(steps), dtype=bool) if self.limit is None else steps > self.limit
        emit = data.loc[kept, self.names].assign(**{self.time: rebuilt, self.dt: steps, DUPLICATE: same[kept], BIG: big})
        elapsed = before + np.bincount(owner, weights=steps, minlength=len(starts))
        newest = data.loc[last, self.names].assign(**{_ELAPSED: elapsed, _FLAG: same[last]})
        return emit, pd.concat([*others, newest], ignore_index=True)

    def _bare(self, rows: pd.DataFrame, reason: np.ndarray) -> pd.DataFrame:
        return rows.assign(**{self.dt: np.nan, DUPLICATE: False, BIG: False, LATE: reason})[self.output]

    def close(self) -> None:
        pass


def _kept(state) -> pd.DataFrame | None:
    return _from_bytes(state.get()[0]) if state.exists() else None


def _task_text(df: DataFrame, key: Sequence[str]) -> Column:
    """A key as one text, different for different keys; null is a key like others."""

    def text(name: str) -> Column:
        kind, value = df.schema[name].dataType, col(name)
        if isinstance(kind, T.BinaryType):
            plain = F.hex(value)
        elif isinstance(kind, (T.ArrayType, T.StructType)):
            plain = F.to_json(value)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            plain = (value + F.lit(0.0)).cast("string")  # -0.0 is 0.0
        else:
            plain = value.cast("string")
        return F.coalesce(F.concat(F.length(plain).cast("string"), F.lit(":"), plain), F.lit("null"))

    return F.concat(*[text(k) for k in key])


def reordered_time_check(
    stream: DataFrame,
    key: Sequence[str],
    check: TimeCheck,
    event_time: str,
    ties: Sequence[str] = (),
    delay_s: float = 60.0,
    idle_s: float = 3600.0,
    grace: str = "1 hour",
    buckets: int = BUCKETS,
) -> DataFrame:
    """`stream_time_check` for rows out of order: the check's time axis is in seconds, `event_time` is a timestamp.

    Adds the step, the duplicate and large-step flags and the reason (`__late`) of rows put out without a step.
    """
    given = stream.drop(check.dt).withWatermark(event_time, grace)
    plain = {c: f"c{i}" for i, c in enumerate(given.columns)}
    renamed = given.withColumnsRenamed(plain)
    # Rows of many keys share a frame, where pandas would make a whole number with a null among them a double.
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    null = {f.name: f"n{f.name}" for f in renamed.schema if f.name != plain[check.time] and isinstance(f.dataType, whole)}
    task = _task_text(renamed, [plain[k] for k in key])
    dealt = renamed.withColumns(
        {_TASK: task, "bucket": F.pmod(F.xxhash64(task), F.lit(buckets)), **{n: col(c).isNull() for c, n in null.items()}}
    ).withColumns({c: F.coalesce(col(c), F.lit(0).cast(renamed.schema[c].dataType)) for c in null})
    time, names = plain[check.time], [*plain.values(), _TASK, *null.values()]
    fields = [
        T.StructField(f.name, T.DoubleType() if f.name == time else f.dataType) for f in dealt.schema if f.name in names
    ]
    fields.sort(key=lambda f: names.index(f.name))
    flags = [(check_dt := "dt", T.DoubleType()), (DUPLICATE, T.BooleanType()), (BIG, T.BooleanType()), (LATE, T.StringType())]
    tie_order = [c for t in ties for c in (null.get(plain[t]), plain[t]) if c]  # null ties come last
    steps = _TimeSteps(names, time, plain[event_time], tie_order, check_dt, check.max_dt_s, delay_s, int(idle_s * 1000))
    out = dealt.groupBy("bucket").transformWithStateInPandas(
        steps, T.StructType([*fields, *[T.StructField(*f) for f in flags]]), "append", "eventTime"
    )
    out = out.withColumns({c: F.when(~F.col(n), col(c)) for c, n in null.items()})
    flags = [F.col(f[0]) for f in flags]
    return out.select(*plain.values(), *flags).toDF(*given.columns, check.dt, DUPLICATE, BIG, LATE)
