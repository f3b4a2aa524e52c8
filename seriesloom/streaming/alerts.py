"""Alerts with memory: the state of every kind of run is kept between batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from seriesloom.streaming.jobs import stream_run_monitor

ALERT = "kind string, hour timestamp, alert string, value double"
_MEMORY = "above boolean, last long"
_HOURS = "window_start timestamp_ntz, kind string, events long, mean_value double, drift_score double"


def hourly_alerts(hours: DataFrame, threshold: float, silence_hours: int = 24) -> DataFrame:
    """``kind, hour, alert, value`` of a stream of closed hours (``window_start, kind, mean_value``, hours in order from batch to batch).

    ``raised`` when the mean of an hour passes ``threshold``, ``cleared`` when it comes back: one alert per crossing, none while a kind stays above.
    ``silent``, with the last hour seen, when more than ``silence_hours`` lie between an hour and the next one of its kind. The state holds two numbers per kind and
    expires with the silence; after that a kind starts anew below the threshold. A missing kind or mean gives no alert.
    """
    timed = hours.where("kind IS NOT NULL AND mean_value IS NOT NULL").select(
        F.col("window_start").cast("timestamp").alias("hour"), "kind", F.col("mean_value").alias("value")).withWatermark("hour", "1 hour")
    silence = silence_hours * 3_600_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        above, last = state.get if state.exists else (False, None)
        found = []
        stamp = lambda ms: pd.Timestamp(ms, unit="ms")
        if state.hasTimedOut:
            found.append((key[0], stamp(last), "silent", None))
            state.remove()
        else:
            closed = pd.concat(list(parts)).sort_values("hour")  # the hours of one kind that have closed since the last batch
            for hour, mean in zip(closed["hour"], closed["value"]):
                now = int(hour.timestamp() * 1000)
                if last is not None and now - last > silence:
                    found.append((key[0], stamp(last), "silent", None))
                    above = False
                if (mean > threshold) != above:
                    above = not above
                    found.append((key[0], stamp(now), "raised" if above else "cleared", float(mean)))
                last = now
            if last is not None:
                # the hour that would still be in time starts at last + silence and closes an hour later
                due = last + silence + 3_600_000
                if due > state.getCurrentWatermarkMs():
                    state.update((above, last))
                    state.setTimeoutTimestamp(due)
                else:
                    found.append((key[0], stamp(last), "silent", None))
                    if state.exists:
                        state.remove()
        yield pd.DataFrame(found, columns=["kind", "hour", "alert", "value"])

    return timed.groupBy("kind").applyInPandasWithState(step, ALERT, _MEMORY, "append", "EventTimeTimeout")


def stream_alerts(
    stream: DataFrame, ts: str, kind: str, value: str, threshold: float, path: str, checkpoint: str, silence_hours: int = 24,
) -> StreamingQuery:
    """Closed hours appended below ``path/hours``, where events are combined before the shuffle, and their alerts below ``path/alerts``.

    Started again with the same paths it goes on where it stopped, and no alert comes twice. Events more than an hour late are dropped. The query of the alerts is
    returned; that of the hours has ended by then, as both take what is there and stop.
    """
    spark = stream.sparkSession
    stream_run_monitor(stream, ts, kind, value, f"{path}/hours", f"{checkpoint}/hours").awaitTermination()
    hours = spark.readStream.schema(_HOURS).parquet(f"{path}/hours")
    return hourly_alerts(hours, threshold, silence_hours).writeStream.outputMode("append").format("parquet").option(
        "path", f"{path}/alerts").option("checkpointLocation", f"{checkpoint}/alerts").trigger(availableNow=True).start()
