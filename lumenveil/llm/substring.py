"""Removal of long repeated passages, by compaction of a De Bruijn graph whose edges are word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, discard, materialize, mix, prefix_sums, row_key, small_batches, stretch, word_hashes, words_of

class Roller:
    """Hashes of any stretch of a text's words, from prefix sums over two 64-bit hashes of each word. Words and sums differ
    between the two, so that two stretches count as equal only if 128 bits agree."""

    def __init__(self, words: tuple[np.ndarray, ...]):
        self.n = len(words[0])
        self.sums = [prefix_sums(h, base) for h, base in zip(words, BASES, strict=True)]

    def of(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return stretch(self.sums[k], start, end)


def paths_of(roller: Roller, window: int, core: int) -> tuple[np.ndarray, ...]:
    """Nonbranching paths of one text: maximal runs lo..hi of windows that share their least core (leftmost if tied).

    Returns (core's hash, hash of the whole path, lo, hi). Which core is least depends on a window's own words only, so
    equal windows lie in paths of the same core."""
    n = roller.n
    at = np.arange(n - core + 1)
    cores = roller.of(0, at, at + core)
    least = np.lib.stride_tricks.sliding_window_view(cores, window - core + 1).argmin(axis=1)
    place = least + np.arange(n - window + 1)
    lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    hi = np.concatenate([lo[1:], [len(place)]]) - 1
    whole = roller.of(1, lo, hi + window) ^ mix((place[lo] - lo).astype(np.uint64) * np.uint64(1 << 32) + (hi - lo).astype(np.uint64) + np.uint64(1))
    return cores[place[lo]], whole, lo, hi


def _batch(parts: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def repeated_spans(docs: DataFrame, window: int = 35, core: int = 10) -> DataFrame:
    """(id, key, spans): for rows of docs (id, key, text), the stretches [start, end) of words that lie in a window of
    `window` words which also starts elsewhere, the same row included. Rows without any are left out.

    1. Each window is an edge. Consecutive edges with the same least core form a path; only paths are shuffled.
    2. Cores that occur twice are joined with the paths; others can't repeat.
    3. Paths that occur twice as a whole repeat in full.
    4. Where paths of one core differ (a branch), one of each is taken back to its source text by its coordinates, cut into
       edges, and the edges are counted; a path that occurred once gets those of its edges that occur elsewhere.
    Counts are partial sums, and joins by core are skew joins: a passage that a third of the rows share is never gathered.
    """

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for doc, key, words in zip(b.column("id").to_pylist(), b.column("key").to_pylist(), word_hashes(b.column("text"), n=2), strict=True):
                if len(words[0]) >= window:
                    a, f, lo, hi = paths_of(Roller(words), window, core)
                    parts.append((np.full(len(a), doc), np.full(len(a), key), a, f, lo, hi))
            yield _batch(parts, ["id", "key", "a", "f", "lo", "hi"], [pa.int64()] * 4 + [pa.int32()] * 2)

    found = materialize(docs.select("id", "key", "text").mapInArrow(paths, "id long, key long, a long, f long, lo int, hi int"), "spans-found")
    # Written, so that the join below shuffles both sides for itself and a hot core can be split there.
    twice = materialize(found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "spans-cores")
    met = materialize(found.join(twice, "a", "left_semi"), "spans-met")
    discard(found, twice)
    whole = materialize(met.groupBy("a", "f").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "lo", "hi")).alias("at")), "spans-paths")
    full = met.join(whole.where("n > 1").select("a", "f"), ["a", "f"], "left_semi").select("id", "key", F.col("lo").alias("s"), (F.col("hi") + window).alias("e"))
    branch = whole.groupBy("a").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("a")
    one = whole.join(branch, "a", "left_semi").select("at.*", "a", "n")
    by_row = one.groupBy("id", "key").agg(F.collect_list(F.struct("a", "n", "lo", "hi")).alias("paths"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for doc, key, words, own in zip(b.column("id").to_pylist(), b.column("key").to_pylist(), word_hashes(b.column("text"), n=2), b.column("paths").to_pylist(), strict=True):
                roller = Roller(words)
                for p in own:
                    at = np.arange(p["lo"], p["hi"] + 1)
                    same = np.ones(len(at), np.int64)
                    parts.append((same * doc, same * key, same * p["a"], roller.of(1, at, at + window), at.astype(np.int32), same * p["n"]))
            yield _batch(parts, ["id", "key", "a", "w", "s", "n"], [pa.int64()] * 4 + [pa.int32(), pa.int64()])

    cut = docs.select("id", "key", "text").join(by_row, ["id", "key"]).mapInArrow(edges, "id long, key long, a long, w long, s int, n long")
    cut = materialize(cut, "spans-edges")
    again = cut.groupBy("a", "w").agg(F.sum("n").alias("all")).where("all > 1").select("a", "w")
    part = cut.where("n = 1").join(again, ["a", "w"], "left_semi").select("id", "key", "s", (F.col("s") + window).alias("e"))
    return full.union(part).groupBy("id", "key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = 35, core: int = 10) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text), a row for each row of docs (doc_id, text).

    Removes each word that a window covers which starts anywhere else too; windows are those of the input. All copies of a
    passage go. Null and empty texts have no words (kept_sha256 is that of no bytes), texts shorter than a window lose
    nothing. Rows that repeat, ids included, are places like any others: each is a repeat of the other. kept_text is null
    for null texts and else the kept words, joined by one space.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), row_key().alias("key"))
    spans = repeated_spans(rows, window, core)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, gone, shas, kept = [], [], [], []
            for text, own in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = words_of(text)
                counts.append(len(words))
                if own:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, [x["s"] for x in own], 1)
                    np.add.at(step, [x["e"] for x in own], -1)
                    out = np.cumsum(step[:-1]) > 0
                    words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                gone.append(counts[-1] - len(words))
                left = b" ".join(words)
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(None if text is None else left.decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    joined = rows.join(spans, ["id", "key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cleaned, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
