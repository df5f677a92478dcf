"""The per-document path on streams, windowed monitoring and the interaction log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.spans import mask
from ..operators.detect import detect


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, masked_text, n_entities): a map over rows without a shuffle, the same on a table and on a stream."""
    found = detect(docs)
    return found.select("doc_id", mask(F.coalesce("text", F.lit("")), F.col("entities")).alias("masked_text"), F.size("entities").alias("n_entities"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) over tumbling windows of events (ts, event_type, value); late events count up to the watermark."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, n) over sessions that a gap ends."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def append_log(entries: DataFrame, path: str, checkpoint: str):
    """Starts a stream that appends interactions to a log of JSON lines, each once."""
    return entries.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def with_survey(log: DataFrame, surveys: DataFrame) -> DataFrame:
    """Log rows (session, at) with the survey (session, survey) that amends a session's last row."""
    last = log.groupBy("session").agg(F.max("at").alias("at")).join(surveys, "session")
    return log.join(last, ["session", "at"], "left")


AMENDED = "session string, at timestamp, entry string, survey string"


def amended(steps: DataFrame, wait: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A stream of log rows (session, at, entry, survey), each once, the one before a survey with it, from a stream of steps
    (session, at, entry, survey), of which each has an entry or a survey.

    A session's last row is kept as its state until a survey amends it, a newer row comes or `wait` passes on the events' clock.
    A survey amends the row that is kept, even if its own time is before it. A survey that finds none, because it is repeated or
    too late, is a row of its own without an entry. Steps of one batch go by their time, entries before surveys of the same time.
    Steps without a session or a time are left out; those behind the watermark too, as in all event-time streams."""
    seconds = pd.Timedelta(wait)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        kept = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], kept[0], kept[1], None)], columns=["session", "at", "entry", "survey"])
            return
        rows = pd.concat(list(batches))
        rows = rows.assign(_order=rows["entry"].isna()).sort_values(["at", "_order", "entry", "survey"])
        for at, entry, survey in zip(rows["at"], rows["entry"], rows["survey"], strict=True):
            if entry is not None:
                if kept is not None:
                    out.append((key[0], kept[0], kept[1], None))
                kept = (at.to_pydatetime(), entry)
            else:
                out.append((key[0], *(kept or (at.to_pydatetime(), None)), survey))
                kept = None
        if kept is not None:
            state.update(kept)
            end = int((pd.Timestamp(kept[0]) + seconds).timestamp() * 1000)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session", "at", "entry", "survey"])

    some = steps.select("session", "at", "entry", "survey").where("session is not null and at is not null and (entry is not null or survey is not null)")
    return some.withWatermark("at", late).groupBy("session").applyInPandasWithState(step, AMENDED, "at timestamp, entry string", "append", GroupStateTimeout.EventTimeTimeout)
