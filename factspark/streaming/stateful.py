"""Alerts with pending state and bounded lists of recent rows, over streams, in keyed state.

Both emit changes: a later row for the same key and name replaces an earlier
one; alerts() and recent() read such a log back as what it describes. Rows may come
late by `late` seconds; the part of a key's history that can still change is
held in its state and looked at again with each batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Rule:
    """An alert. Without windows its condition is a bad row; with them, the share of bad among all counted rows over both windows is above the limit."""

    name: str
    for_s: int = 0
    limit: float = 0.0
    long_s: int = 0
    short_s: int = 0

    def holds(self, t: np.ndarray, bad: np.ndarray, total: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The condition at the rows `at`, from the cumulative counters of all rows."""
        if not self.long_s:
            return np.diff(np.r_[0, bad])[at] > 0
        out = np.ones(len(at), bool)
        for seconds in (self.long_s, self.short_s):
            start = np.searchsorted(t, t[at] - seconds)  # the first sample in the window is what increases count from
            n = total[at] - total[start]
            out &= (n > 0) & ((bad[at] - bad[start]) > self.limit * n)
        return out


class Runs:
    """The run that a rule is in, if any: since, last, length, fired (-1: none)."""

    def __init__(self, since: int = -1, last: int = -1, length: int = 0, fired: int = -1) -> None:
        self.since, self.last, self.length, self.fired = since, last, length, fired

    def step(self, t: int, bad: bool, for_s: int) -> None:
        if not bad:
            self.__init__()
            return
        if self.since < 0:
            self.since = t
        self.last, self.length = t, self.length + 1
        if self.fired < 0 and t - self.since >= for_s:
            self.fired = t

    def row(self) -> tuple[int, int, int, int]:
        return self.since, self.last, self.length, self.fired


ALERT = "rule string, first long, last long, length long, fired_at long"
ALERT_STATE = "cutoff long, t array<long>, bad array<long>, total array<long>, runs array<long>, shown array<array<long>>"


def _alerts(rules: Sequence[Rule], late: int):
    reach = max((r.long_s for r in rules), default=0)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cutoff, t, bad, total, runs, shown = state.get if state.exists else (-(1 << 62), [], [], [], [-1, -1, 0, -1] * len(rules), [])
        parts = [np.array([t, bad, total], np.int64)]
        for f in frames:
            fresh = f[f["t"].to_numpy(np.int64) > cutoff]  # what is later than allowed is left out
            parts.append(fresh[["t", "bad", "total"]].to_numpy(np.int64).T)
        every = np.concatenate(parts, axis=1)
        t, inverse = np.unique(every[0], return_inverse=True)
        bad, total = (np.bincount(inverse, every[i], len(t)).astype(np.int64) for i in (1, 2))  # rows of one second are one sample
        counted, all_ = np.cumsum(bad), np.cumsum(total)
        at = np.flatnonzero(t > cutoff)
        new_cutoff = max(cutoff, int(t[-1]) - late) if len(t) else cutoff
        out, kept, still = [], [], []
        for i, rule in enumerate(rules):
            run = Runs(*runs[4 * i : 4 * i + 4])
            settled = run.row()
            found = {run.since: settled} if run.since >= 0 else {}
            for j, hit in zip(at.tolist(), rule.holds(t, counted, all_, at).tolist()):
                run.step(int(t[j]), hit, rule.for_s)
                if hit:
                    found[run.since] = run.row()
                if t[j] <= new_cutoff:
                    settled = run.row()
            was = set(shown[i]) if len(shown) else set()
            out += [(rule.name, *row) for row in found.values()]
            out += [(rule.name, first, -1, 0, -1) for first in was - set(found)]  # a late row has undone it
            kept += settled
            still.append([first for first in found if first > new_cutoff])
        yield pd.DataFrame(out, columns=["rule", "first", "last", "length", "fired_at"]).assign(key=key[0])
        keep = t > new_cutoff - reach - 1
        state.update((new_cutoff, t[keep].tolist(), bad[keep].tolist(), total[keep].tolist(), list(kept), still))

    return update


def alert_changes(samples: DataFrame, rules: Sequence[Rule], late: int = 0, key_type: str = "long") -> DataFrame:
    """Changes of the runs of each rule and key over rows (key, t, bad, total); t in seconds, bad and total are what the row counts.

    A run begins with the first row for which the condition holds and ends with
    the first for which it doesn't; it fires at the first row at least `for_s`
    seconds after it began. length 0 takes a run back. Null keys are one key;
    rows with a null t, and rows later than `late` seconds, are left out.
    """
    schema = f"key {key_type}, {ALERT}"
    known = samples.filter("t IS NOT NULL").select("key", "t", F.coalesce("bad", F.lit(0)).cast("long").alias("bad"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    return known.groupBy("key").applyInPandasWithState(_alerts(rules, late), schema, ALERT_STATE, "update", GroupStateTimeout.NoTimeout)


def _recent(n: int):
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for f in frames:  # a batch of a key comes in pieces, of which n rows are kept at a time
            held = sorted([*held, *zip(f["at"].tolist(), f["id"].tolist())], reverse=True)[:n]
        state.update(([h[0] for h in held], [h[1] for h in held]))
        yield pd.DataFrame({"key": [key[0]] * len(held), "place": range(1, len(held) + 1), "at": [h[0] for h in held], "id": [h[1] for h in held]})

    return update


def recent_changes(rows: DataFrame, n: int, key_type: str = "long") -> DataFrame:
    """The n latest rows of each key that a batch brings rows of, over rows (key, at, id) of longs: key, place (1: latest), at, id.

    Ties of `at` go to the larger id. State and output hold n rows a key at
    most, however many rows it gets. Rows with a null time or id are left out.
    """
    known = rows.filter("at IS NOT NULL AND id IS NOT NULL").select("key", F.col("at").cast("long").alias("at"), F.col("id").cast("long").alias("id"))
    return known.groupBy("key").applyInPandasWithState(_recent(n), f"key {key_type}, place int, at long, id long", "at array<long>, id array<long>", "update", GroupStateTimeout.NoTimeout)


def logged(changes: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream of changes over all that is there now; the log of its changes, with the number of the batch.

    A batch is written under its number, so that one that is repeated after a
    failure replaces itself. A stream that is started again with the same
    checkpoint goes on where it ended.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = changes.sparkSession
    fields = "batch long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema.fields)
    return spark.read.schema(fields).option("basePath", path).parquet(path)


def alerts(log: DataFrame) -> DataFrame:
    """The runs that a log of alert changes describes; fired_at is null for a run that hasn't fired."""
    latest = log.groupBy("key", "rule", "first").agg(F.max_by(F.struct("last", "length", "fired_at"), "batch").alias("r"))
    return latest.filter("r.length > 0").select("key", "rule", "first", "r.last", "r.length", F.when(F.col("r.fired_at") >= 0, F.col("r.fired_at")).alias("fired_at"))


def recent(log: DataFrame) -> DataFrame:
    """The lists that a log of recent rows describes: key, place, at, id."""
    last = log.groupBy("key", "place").agg(F.max_by(F.struct("at", "id"), "batch").alias("r"))  # lists never get shorter
    return last.select("key", "place", "r.at", "r.id")
