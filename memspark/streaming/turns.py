"""Agent turns as bounded state: one short summary per open turn, however many requests it has."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memspark.operators.scope import SCOPE
from memspark.streaming.jobs import MAX_TOOL_TAGS, TURN_TTL

#: A turn in state, times in microseconds: first request, end (last request plus its time to live), requests, last
#: non-empty answer with its time, the tools used first with their first use.
TURN_STATE = "started bigint, ended bigint, n bigint, answer string, answered bigint, tools array<string>, used array<bigint>"
_OUT = "started bigint, ended bigint, n_requests bigint, answer string, tools array<string>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_used(uses: dict[str, int]) -> dict[str, int]:
    """The tools used first, ties by name. A tool left out can only return by an earlier use, so cutting early is exact."""
    return dict(sorted(uses.items(), key=lambda u: (u[1], u[0]))[:MAX_TOOL_TAGS])


def merged(a: tuple, b: tuple) -> tuple:
    """Two stretches of one turn as one."""
    uses = dict(zip(a[5], a[6]))
    for tool, at in zip(b[5], b[6]):
        uses[tool] = min(at, uses.get(tool, at))
    uses = first_used(uses)
    answer = max((x for x in ((a[4], a[3]), (b[4], b[3])) if x[1] is not None), default=(None, None))
    return min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], answer[1], answer[0], list(uses), list(uses.values())


def joined(turns: list[tuple]) -> list[tuple]:
    """Stretches in any order as turns: those that overlap become one, in time order."""
    out: list[tuple] = []
    for turn in sorted(turns, key=lambda t: t[:2]):
        if out and turn[0] < out[-1][1]:
            out[-1] = merged(out[-1], turn)
        else:
            out.append(turn)
    return out


def stretches(rows: pd.DataFrame) -> list[tuple]:
    """Requests (``at``, ``end``, ``answer``, ``tool``) of one key as turns. Plain Python, as turns are many and short."""
    rows = rows.iloc[rows["at"].to_numpy().argsort(kind="stable")]
    out, last = [], None
    for at, end, answer, tool in zip(*(rows[c].tolist() for c in ("at", "end", "answer", "tool"))):
        if last is None or at >= last[1]:
            last = [at, end, 0, None, None, {}]
            out.append(last)
        last[1], last[2] = max(last[1], end), last[2] + 1
        if isinstance(answer, str) and answer and (last[4] != at or answer > last[3]):
            last[3], last[4] = answer, at
        if isinstance(tool, str) and tool:
            last[5].setdefault(tool, at)
    uses = [first_used(turn[5]) for turn in out]
    return [(*turn[:5], list(u), list(u.values())) for turn, u in zip(out, uses)]


class Turns(StatefulProcessor):
    """Folds requests into open turns and gives a turn out once the watermark has passed its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", TURN_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = [tuple(t) for t in self.open.get()]
        before = self.alarm(turns)
        for part in rows:
            if len(part):
                turns = joined(turns + stretches(part))
        yield from self.settle(key, turns, before, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turns = [tuple(t) for t in self.open.get()]
        yield from self.settle(key, turns, None, timerValues)  # the only timer of the key has just gone off

    @staticmethod
    def wake(ended: int) -> int:
        """First whole millisecond at which a turn is over."""
        return -(-ended // 1000)

    def alarm(self, turns: list[tuple]) -> int | None:
        """One timer a key: the end of the turn that is over first."""
        return min((self.wake(t[1]) for t in turns), default=None)

    def settle(self, key, turns: list[tuple], before: int | None, timer_values) -> Iterator[pd.DataFrame]:
        now = timer_values.getCurrentWatermarkInMs()
        over, still = [t for t in turns if self.wake(t[1]) <= now], [t for t in turns if self.wake(t[1]) > now]
        self.open.put(still) if still else self.open.clear()
        after = self.alarm(still)
        if before is not None and before != after:
            self.handle.deleteTimer(before)
        if after is not None and before != after:
            self.handle.registerTimer(after)
        if over:
            names = [*SCOPE, "turn_key"]
            yield pd.DataFrame(
                [(*key, *t[:4], list(t[5])) for t in over], columns=[*names, "started", "ended", "n_requests", "answer", "tools"],
            ).astype({n: object for n in (*names, "answer", "tools")})

    def close(self) -> None:
        pass


def stream_turns(requests: DataFrame, *, ttl: str = TURN_TTL, lateness: str = "15 minutes") -> DataFrame:
    """``jobs.agent_turns`` of a stream with bounded state per turn; same columns and turns.

    A request is late when the turn it would open alone was over for the batch before. Requests without a time take no
    part. Keys may be null. Answers of one instant: the greatest counts.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    types = dict(requests.dtypes)
    # no leading underscores: such columns reach the tasks under other names
    rows = requests.filter(F.col("ts").isNotNull()).withColumn("ends", F.col("ts") + F.expr(f"INTERVAL {ttl}"))
    # ends run ahead of requests by the time to live, and so does what may still come
    rows = rows.withWatermark("ends", f"{lateness} {ttl}")
    rows = rows.select(*SCOPE, "turn_key", "ends", F.unix_micros("ts").alias("at"), F.unix_micros("ends").alias("end"), "answer", "tool")
    schema = ", ".join(f"{c} {types[c]}" for c in (*SCOPE, "turn_key")) + ", " + _OUT
    out = rows.groupBy(*SCOPE, "turn_key").transformWithStateInPandas(Turns(), schema, "append", "eventTime")
    tags = F.transform("tools", lambda n: F.concat(F.lit("tool:"), n))
    return out.select(
        *SCOPE, "turn_key", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "n_requests", "answer",
        F.when(F.size(tags) > 0, F.concat(F.array(F.lit("agent")), tags)).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
