"""What the corpus operators share: words, row keys, shared tables, linked components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and words, wherever an operator counts words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; null has none. bytes.split() parts at exactly the six characters of SPACE."""
    return text.encode("utf-8", "replace").split() if text else []


#: Odd factors of rolling hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Bytes of text that are hashed at once; more only for a text that is longer by itself.
STRETCH = 1 << 18


def marks(of: bytes) -> np.ndarray:
    """Which of the 256 bytes are among `of`."""
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


SPACES = marks(b" \t\n\x0b\x0c\r")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; callers round n up, so that few sizes occur."""
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return up, down


def prefix_sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which stretch() gets the polynomial hash of any stretch of values."""
    up, down = powers(base, 1 << max(10, len(values).bit_length()))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)]), down


def stretch(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[0][end] - sums[0][start]) * sums[1][start])


def word_hashes(column: pa.Array, fold: np.ndarray | None = None, parts: np.ndarray = SPACES, n: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """For each text of an Arrow column, n arrays of 64-bit hashes of its words, in order; null texts have none.

    Words are stretches without a byte of `parts`; `fold` maps each byte before that. All in array operations on the column's
    own bytes: no Python object for a word is made.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(places, places[at] + STRETCH, "right")) - 1)
        lo, own = int(places[at]), places[at : to + 1] - places[at]
        data = raw[lo : lo + int(own[-1])]
        if fold is not None:
            data = fold[data]
        word = ~parts[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[own] = True
        before = np.concatenate([[False], word[:-1]]) if len(word) else word
        start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.concatenate([word[1:], [False]]) if len(word) else word
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        # Bytes are spread over 64 bits first, so that short words differ in all of them.
        value = SPREAD[data]
        hashes = [stretch(prefix_sums(value, base), start, end) for base in BASES[:n]]
        first = np.searchsorted(start, own)
        for k in range(to - at):
            yield tuple(h[first[k] : first[k + 1]] for h in hashes)
        at = to


SPREAD = mix(np.arange(1, 257, dtype=np.uint64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    With neither, one is set here for a local master only (tests): on a cluster a machine's own folder would lose tables."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenveil-"))
        given = spark.sparkContext.getCheckpointDir()
    return given.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Python workers get 8 MB of rows at a time, where the session leaves Spark's own limit of 64 MB: several copies of a batch
    are held at once, by Spark and by the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864"):
        spark.conf.set(key, "8m")


#: Where the tables of materialize() lie, as long as they do.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_RECORDS: list[set[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _RECORDS:
        made.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of materialize() that nothing reads any more; others are left alone."""
    for df in tables:
        if df is not None and (path := _PATHS.pop(df, None)):
            delete(df.sparkSession, [path])


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        for made in _RECORDS:
            made.discard(path)


def swept(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that the driver holds no longer, when its garbage is collected: now."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def recorded() -> Iterator[set[str]]:
    """The set of paths of the tables made inside that are still there."""
    made: set[str] = set()
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> Column:
    """Tells rows of documents apart that share a doc_id; rows equal in id and text share a key and a fate."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def components(edges: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
    """Distributed union-find over edges (a, b): one row (id, root) for each node that has an edge; root is the least id reachable.

    `known`: (id, root) of earlier edges, which count as well; edges are new ones only then.
    A round hooks each root below its least neighbour, halves the paths of the forest twice, and contracts the edges by it.
    At most the local minima stay roots, half of them with ids in random order; so rounds are few whatever the diameter, and
    each works on what is left of the last. A path that is not yet short stays as an edge. The least id of a component never
    hooks, so it is the root in the end. Minima are summed up partially and joins split hot nodes. Former rounds' tables go.
    """
    two = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    up = lambda forest, end, to: forest.select(F.col("id").alias(end), F.col("root").alias(to))

    def contracted(e: DataFrame, forest: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            e = e.join(up(forest, end, "_to"), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        return e.select("a", "b")

    left = materialize(two(edges if known is None else contracted(edges.select("a", "b"), known)), f"{name}-edges")
    forests: list[DataFrame] = []
    while left.head(1):
        hooked = left.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("root"))
        for _ in range(2):
            hooked = hooked.join(hooked.select(F.col("id").alias("root"), F.col("root").alias("above")), "root").select("id", F.col("above").alias("root"))
        forest = materialize(hooked, f"{name}-forest")
        forests.append(forest)
        paths = forest.select(F.col("root").alias("a")).distinct().join(up(forest, "a", "b"), "a").where("a <> b")
        last, left = left, materialize(two(contracted(left, forest).union(paths.select("a", "b"))), f"{name}-edges")
        discard(last)
    discard(left)
    if not forests:
        return known if known is not None else materialize(edges.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0), f"{name}-root")
    root = forests[-1]
    for forest in reversed(forests[:-1]):
        root = forest.join(root.select(F.col("id").alias("root"), F.col("root").alias("above")), "root", "left").select("id", F.coalesce("above", "root").alias("root"))
    if known is not None:
        # A known root that met others has its new one in `root`; nodes that are new are in no known component.
        old = known.join(root.select(F.col("id").alias("root"), F.col("root").alias("above")), "root", "left").select("id", F.coalesce("above", "root").alias("root"))
        root = old.union(root.join(known.select("id"), "id", "left_anti"))
    root = materialize(root, f"{name}-root")
    discard(*forests)
    return root
