"""Verdict stream: the tuning policy per session, with state that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackframe.operators.contracts import GO_ON, STOP_RULES
from trackframe.session import shared_folder
from trackframe.streaming.closing import keyed_state, run_to_end, with_end

ROW = ["seq", "at", "verdict", "score", "has_deltas"]
HELD = "seq long, at long, verdict string, score double, has_deltas boolean"
STATE = "seq long, n long, before double, best double, best_i long, stopped boolean, reason string, until long"
OUT = "session long, seq long, verdict string, score double, iteration long, go boolean, reason string, best long, stopped boolean, late boolean"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Policy:
    """The policy's state over one session's verdicts in order."""

    def __init__(self, seq: int | None = None, n: int = 0, before: float | None = None, best: float | None = None, best_i: int = -1, stopped: bool = False, reason: str = "", until: int = 0):
        self.seq, self.n, self.before, self.best, self.best_i, self.stopped, self.reason, self.until = seq, n, before, best, best_i, stopped, reason, until

    def state(self) -> tuple:
        return self.seq, self.n, self.before, self.best, self.best_i, self.stopped, self.reason, self.until

    def take(self, seq: int, verdict: str, score: float, has_deltas: bool) -> tuple | None:
        """The answer to the next verdict: (iteration, go, reason, best, stopped), nothing for a reset."""
        self.seq = seq
        if verdict == "reset":
            self.n, self.before, self.best, self.best_i, self.stopped, self.reason = 0, None, None, -1, False, ""
            return None
        if self.stopped:
            return self.n, False, self.reason, self.best_i, True
        self.n += 1
        if self.best is None or score > self.best:
            self.best, self.best_i = score, self.n - 1
        row = SimpleNamespace(verdict=verdict, score=score, has_deltas=has_deltas, n=self.n, gain=float("inf") if self.before is None else score - self.before)
        why = next((text for text, holds in STOP_RULES if holds(row)), None)
        self.before, self.stopped, self.reason = score, why is not None, why or GO_ON
        return self.n, not self.stopped, self.reason, self.best_i, False


class Sessions(StatefulProcessor):
    """Holds each session's verdicts until event time has passed them by `hold`, then takes them by `seq`."""

    def __init__(self, hold: int, ttl: int, slack: int):
        self.hold, self.ttl, self.slack = hold, ttl, slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held, self.last = handle.getListState("held", HELD), handle.getValueState("last", STATE)

    def _policy(self) -> Policy:
        return Policy(*self.last.get()) if self.last.exists() else Policy()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        policy = self._policy()
        for pdf in rows:
            if key[0] is None:  # the stream's end
                continue
            pdf = pdf.assign(at=pdf["ts"].astype("datetime64[ms]").astype("int64"))
            gone = pdf["seq"] <= policy.seq if policy.seq is not None else pd.Series(False, index=pdf.index)
            yield self._late(key, pdf[gone])
            new = pdf[~gone]
            if len(new):
                self.held.appendList(list(new[ROW].itertuples(index=False, name=None)))
                # the watermark trails event time by `slack`, so a timer at at + hold - slack fires once event time is at + hold
                self.handle.registerTimer(int(new["at"].max()) + self.hold - self.slack)
                until = int(new["at"].max()) + self.ttl - self.slack
                if until > policy.until:
                    policy.until = until
                    self.handle.registerTimer(until)
                    self.last.update(policy.state())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() + self.slack - self.hold
        due, rest = [], []
        for r in self.held.get() if self.held.exists() else ():
            (due if r[1] <= now else rest).append(tuple(r))
        policy = self._policy()
        if due:
            due.sort()
            out = []
            for seq, _, verdict, score, has_deltas in due:
                got = policy.take(seq, verdict, float(score), bool(has_deltas))
                if got:
                    out.append((key[0], seq, verdict, score, *got, False))
            self.held.put(rest) if rest else self.held.clear()
            self.last.update(policy.state())
            yield _frame(out)
        if not rest and policy.until <= timerValues.getCurrentWatermarkInMs():
            self.held.clear()
            self.last.clear()

    def _late(self, key, pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame([(key[0], r.seq, r.verdict, r.score, None, None, None, None, None, True) for r in pdf.itertuples(index=False)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of the result, with plain objects where a value may be missing."""
    return pd.DataFrame(rows, columns=COLUMNS, dtype=object).astype({"session": "int64", "seq": "int64", "score": "float64", "late": "bool"})


def judge_stream(verdicts: DataFrame, ttl: str = "1 day", hold: str = "1 hour") -> DataFrame:
    """Decisions for a stream of verdicts (session, seq, ts, verdict, score, has_deltas).

    A verdict waits until event time has moved `hold` past it; then the session's waiting verdicts are taken
    by `seq`, in whatever order and files they came. One that comes after a later one was taken changes nothing
    any more: it comes out with `late` true and no decision (`late_counts` counts them). After a stop, further
    verdicts are answered `stopped` until a row with verdict 'reset'. A session's state is eight values and what
    waits; it expires once event time has moved `ttl` past its last row, which replaces a fixed number of
    sessions. Rows older than that are dropped by Spark, which counts them in its progress reports.
    """
    keyed_state(verdicts.sparkSession)
    ms = lambda t: int(pd.Timedelta(t).total_seconds() * 1000)
    timed = verdicts.withWatermark("ts", ttl)
    processor = Sessions(min(ms(hold), ms(ttl)), ms(ttl), ms(ttl))
    return timed.groupBy("session").transformWithStateInPandas(processor, OUT, "append", "EventTime")


def drain(verdicts: DataFrame, name: str, **how: str) -> DataFrame:
    """Run a stream of verdicts to its end into a table and read the decisions back."""
    spark = verdicts.sparkSession
    root = shared_folder(spark, name)
    stream, end = with_end(verdicts, f"{root}/end")
    made = judge_stream(stream, **how)
    run_to_end(lambda: made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out"), end)
    return spark.read.schema(made.schema).parquet(f"{root}/out")


def late_counts(decisions: DataFrame) -> DataFrame:
    """(session, late): how many verdicts of each session came too late to count."""
    return decisions.filter("late").groupBy("session").agg(F.count(F.lit(1)).alias("late"))
