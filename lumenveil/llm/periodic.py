"""Runs of words that repeat with a period, found by probing the multiples of each period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, small_batches, words_of

#: Grid points that are tested at once, and words that are compared at once when a run is extended.
TILE, STRIDE = 1 << 17, 256
RUN = "struct<start:bigint,length:bigint,period:bigint>"
FOUND = f"runs array<{RUN}>, collapsed string"


def extended(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The stretch [start, end) around `at`, where words `period` apart are equal, that no neighbour extends; chunk by chunk."""
    n = len(ids) - period
    end, step = at, STRIDE
    while end < n:
        differ = np.flatnonzero(ids[end : min(end + step, n)] != ids[end + period : min(end + step, n) + period])
        if len(differ):
            end += int(differ[0])
            break
        end, step = min(end + step, n), step * 2
    start, step = at, STRIDE
    while start > 0:
        lo = max(0, start - step)
        differ = np.flatnonzero(ids[lo:start] != ids[lo + period : start + period])
        if len(differ):
            start = lo + int(differ[-1]) + 1
            break
        start, step = lo, step * 2
    return start, end + period


def survivors(ids: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, grid number j), ordered, for periods low..high (below 2 * low): places jp where the words at jp, (j+1)p, (j+2)p
    and (j+3)p are equal. A run of four periods or more holds four grid points, wherever it begins."""
    n = len(ids)
    grid = (n - 1) // low - 2  # grid numbers j with (j + 3) * low < n
    for first in range(low, high + 1, max(1, TILE // max(grid, 1))):
        periods = np.arange(first, min(high + 1, first + max(1, TILE // max(grid, 1))))
        for j in range(0, (n - 1) // first - 2, TILE):
            numbers = np.arange(j, min((n - 1) // first - 2, j + TILE))
            at = periods[:, None] * numbers[None, :]
            last = at + 3 * periods[:, None]
            inside = last < n
            at[~inside] = 0
            own, step = ids[at], np.where(inside, periods[:, None], 0)
            equal = inside & (own == ids[at + step])
            k, m = np.nonzero(equal)
            place, p = at[k, m], periods[k]
            more = (ids[place] == ids[place + 2 * p]) & (ids[place] == ids[place + 3 * p])
            yield p[more], numbers[m][more]


def runs_of(ids: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period), ordered: all stretches of numbers with smallest period p and of a length of at least `least` and
    `times` (4 or more) periods that no neighbour extends.

    Periods are taken in blocks from p to 2p, ascending. Grid points that lie, with the next three, in one run found before are
    passed over: a run of another period shares less than both periods with it. So a stretch is found at its smallest period
    first, and its multiples are never probed.
    """
    n, found = len(ids), []
    reach = np.zeros(n, np.int64)  # the furthest end of a run that holds a place
    low, most = 1, n // times
    while low <= most:
        high = min(2 * low - 1, most)
        for periods, numbers in survivors(ids, low, high):
            place = periods * numbers
            open_ = reach[place] <= place + 3 * periods
            periods, place = periods[open_], place[open_]
            k = 0
            while k < len(place):
                p, at = int(periods[k]), int(place[k])
                k += 1
                if reach[at] > at + 3 * p:
                    continue
                start, end = extended(ids, at, p)
                # Its own four grid points must lie in it: the first place that tells of a run has them inside.
                if end - start >= max(least, times * p) and at + 3 * p < end:
                    found.append((start, end - start, p))
                    np.maximum(reach[start:end], end, out=reach[start:end])
                # Other grid points of this stretch say nothing new.
                same = int(np.searchsorted(periods[k:], p, "right"))
                k += int(np.searchsorted(place[k : k + same], max(end - p, at + 1)))
        low = high + 1
    return sorted(found)


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that lie in no run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, runs, collapsed) for each row of docs (doc_id, text): all periodic runs of its words, ordered by start, then period,
    and the text without the words behind a run's first period, joined by one blank. A map over rows, without a shuffle.

    Words are numbered, so they are compared exactly. Null and empty texts have no words, no runs and an empty collapsed text.
    Rows that repeat are treated alike; null ids stay; other columns are ignored. A text of n words takes memory for a few arrays
    of n numbers and time near n log n, whatever its runs.
    """
    if times < 4:
        raise ValueError("four grid points are probed, so runs have four periods at least")
    small_batches(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, texts = [], []
            for text in b.column("text").to_pylist():
                words, number = words_of(text), {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                own = runs_of(ids, least, times)
                if own:
                    words = [w for w, stays in zip(words, collapsed(len(words), own).tolist(), strict=True) if stays]
                runs.append([{"start": s, "length": length, "period": p} for s, length, p in own])
                texts.append(b" ".join(words))
            kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(runs, kind), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(found, f"doc_id {dict(rows.dtypes)['doc_id']}, {FOUND}")


def words_column(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic end in about a tenth of the texts: of h = crc32(doc_id), h % 10 = 0 and n words, the words
    from h // 10 % n on repeat the first p of them. Other texts, those of null ids and null texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("_h")).select("doc_id", "text", F.floor(F.col("_h") / 10).cast("long").alias("_g"), F.when(F.col("_h") % 10 == 0, words_column(F.col("text"))).alias("_w"))
    sized = chosen.withColumn("_n", F.size("_w"))
    placed = sized.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    period = (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    cut = placed.withColumn("_p", period)
    again = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    words = F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), F.col("_n") - F.col("_a")))
    return cut.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query: counts, the longest run and digests of all runs and of the collapsed text."""
    longest = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = F.col("r.s"), -F.col("r.l"), F.col("r.p")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
