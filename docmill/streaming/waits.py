"""Assets that wait for people, as a stream: a state for each asset, and a timer that reminds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docmill.functions import fixed

OUT = "asset {}, since timestamp, event string, at timestamp, late boolean"
#: The state store that keeps timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Waits(StatefulProcessor):
    """One asset: since when it waits, and whether people were reminded.

    A wait begins with the first ``staged`` event and ends with the next ``decided`` one.  A reminder is due once it has
    lasted for longer than ``limit``: when the watermark passes that time, or when an event beyond it arrives first.
    """

    def __init__(self, days: float):
        self.limit = pd.Timedelta(days=days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("wait", "since timestamp, reminded boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["at", "event"], kind="stable")
        since, reminded = self.state.get() if self.state.exists() else (None, False)
        since, out = None if since is None else pd.Timestamp(since), []
        begun = since
        for at, event in zip(seen["at"], seen["event"], strict=True):
            if since is not None and not reminded and at > since + self.limit:
                out.append((key[0], since, "reminder", since + self.limit, False))
                reminded = True
            if event == "staged" and since is None:
                since, reminded = at, False
            elif event == "decided" and since is not None:
                out.append((key[0], since, "decided", at, reminded))
                since = None
        if since != begun or (begun is not None and reminded):
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        if since is None:
            self.state.clear()
        else:
            self.state.update((since.to_pydatetime(), reminded))
            if not reminded:
                # event time in milliseconds; the watermark has to be beyond the limit, not at it
                self.handle.registerTimer((since + self.limit).value // 1_000_000 + 1)
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, reminded = self.state.get() if self.state.exists() else (None, True)
        out = []
        if not reminded:
            since = pd.Timestamp(since)
            out.append((key[0], since, "reminder", since + self.limit, False))
            self.state.update((since.to_pydatetime(), True))
        yield frame(out)

    def close(self) -> None:
        pass


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["asset", "since", "event", "at", "late"])


def waits(events: DataFrame, late: str = "0 seconds", days: float = fixed.STAGING_DAYS) -> DataFrame:
    """``asset, since, event, at, late`` from a stream of ``asset, event`` (staged, decided; others are ignored) and ``at``.

    A ``reminder`` comes once for a wait of more than ``days``; ``decided`` ends it, and is ``late`` after a reminder.  State
    is held for assets that wait, alone.  Events may come ``late`` by so much; those without an asset or a time are left
    out.  The session's state store must be ``STORE``.
    """
    rows = events.where("asset is not null and at is not null and event in ('staged', 'decided')").select("asset", "event", "at").withWatermark("at", late)
    schema = OUT.format(dict(events.dtypes)["asset"])
    return rows.groupBy("asset").transformWithStateInPandas(statefulProcessor=Waits(days), outputStructType=schema, outputMode="append", timeMode="eventTime")


def waits_of(events: DataFrame, as_of: F.Column, days: float = fixed.STAGING_DAYS) -> DataFrame:
    """The same from a table of all events up to ``as_of``, in one pass of windows."""
    rows = events.where("asset is not null and at is not null and event in ('staged', 'decided')").select("asset", "event", "at")
    # events are taken by time, decisions first where they meet
    w = Window.partitionBy("asset").orderBy("at", "event").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.coalesce(F.count_if(F.col("event") == "decided").over(w), F.lit(0))
    per = rows.withColumn("turn", turn).groupBy("asset", "turn").agg(F.min(F.when(F.col("event") == "staged", F.col("at"))).alias("since"), F.max(F.when(F.col("event") == "decided", F.col("at"))).alias("decided"))
    per = per.where("since is not null").withColumn("due", F.col("since") + F.make_dt_interval(secs=F.lit(days * 86400).cast("decimal(18,6)")))
    reminded = F.coalesce("decided", as_of) > F.col("due")
    both = F.array(F.struct(F.lit("reminder").alias("event"), F.when(reminded, F.col("due")).alias("at"), F.lit(False).alias("late")), F.struct(F.lit("decided").alias("event"), F.col("decided").alias("at"), reminded.alias("late")))
    return per.select("asset", "since", F.explode(F.filter(both, lambda x: x["at"].isNotNull())).alias("x")).select("asset", "since", "x.*")
