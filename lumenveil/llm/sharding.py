"""Shards of near equal size as the leaves of a k-d tree over metadata, split at weighted medians."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType, StringType

from .common import discard, materialize

#: Metadata that the tree splits on, where a caller names none.
DIMS = ("lang", "source", "n_chars")
#: Ranges that a node's keys are counted in at once, and rows of such counts over all nodes of a level.
RANGES, COUNTS = 4096, 1 << 20
#: Bytes of a string that tell its place, behind what all strings of the column share.
LEADING = 7
KEY = "struct<c:bigint,t:bigint,r:bigint>"
SPLITS = "_n bigint, dim int, stage int, _c bigint, _t bigint, low bigint, step bigint, below bigint, wanted double"
CUTS = "node bigint, dim int, cut " + KEY


@dataclass(frozen=True)
class Node:
    """A part of the rows that is to become `leaves` shards. The boundary is sought along `dim`: first among coordinates, then,
    where many rows share one, among hashes, then among row numbers; `c` and `t` are what is settled, `low` and `step` the
    ranges that are counted next, `below` the size of rows before them."""

    number: int
    leaves: int
    size: int = 0
    dim: int = 0
    stage: int = 0
    c: int = 0
    t: int = 0
    low: int = 0
    high: int = 0
    below: int = 0
    cut: tuple[int, int, int] | None = None

    @property
    def wanted(self) -> float:
        return self.size * (self.leaves // 2) / self.leaves

    def step(self, ranges: int) -> int:
        return -(-(self.high - self.low + 1) // ranges)


@dataclass
class Tree:
    """Nodes by number: 1 is the root, 2n and 2n + 1 are the sides of n. leaves: (number, first shard). Holds fewer entries than
    twice the shards."""

    levels: list[list[Node]] = field(default_factory=list)
    leaves: list[tuple[int, int]] = field(default_factory=list)


def coordinate(docs: DataFrame, name: str) -> Column:
    """A place of 0..2**61 for each value, in order. Null, and numbers that are not finite, come first, at 0; whole numbers go by
    their distance from the least, fractions by their share of the column's range, strings by the bytes behind what all
    of them begin with. Other types count as the strings that they print as."""
    own, kind = F.col(f"`{name}`"), docs.schema[name].dataType
    if isinstance(kind, NumericType):
        x = own.cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        low, high = (y or 0.0 for y in docs.agg(F.min(x), F.max(x)).first())
        share = x - low if isinstance(kind, IntegralType) else (x - low) / max(high - low, 1e-300) * float(1 << 53)
        return F.coalesce(F.least(share, F.lit(float(1 << 60))).cast("long") + 1, F.lit(0).cast("long"))
    text = own if isinstance(kind, StringType) else own.cast("string")
    a, b = ((x or "").encode() for x in docs.agg(F.min(text), F.max(text)).first())
    shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    digits = F.rpad(F.hex(F.substring(F.encode(text, "utf-8"), shared + 1, LEADING)), 2 * LEADING, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("long") + 1, F.lit(0).cast("long"))


def breadth(docs: DataFrame, name: str, low: Column, high: Column) -> Column:
    """How far two places are apart: of whole numbers the logarithms count."""
    at = (lambda x: F.log1p(x.cast("double"))) if isinstance(docs.schema[name].dataType, IntegralType) else (lambda x: x.cast("double"))
    return F.coalesce(at(high) - at(low), F.lit(0.0))


def points(docs: DataFrame, dims: tuple[str, ...], carry: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, c, t, r, node): what the tree needs of each row, without its text. c: places by dimension; t: a hash of
    id, text and metadata; r: a number of its own, which only tells rows apart that are equal in all of these. node: the root, stored,
    so that joins with nodes are by a column's values at every level."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    crc = F.crc32(text.cast("binary"))
    told = F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("-")) for x in (F.col("doc_id"), crc, size, *(F.col(f"`{d}`") for d in dims))])
    hashed = F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("long")
    places = F.array(*[coordinate(docs, d) for d in dims]) if dims else F.array().cast("array<bigint>")
    whole = [F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")] if carry else []
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), places.alias("c"), hashed.alias("t"), F.monotonically_increasing_id().alias("r"), F.lit(1).cast("long").alias("node"), *whole)


def order(dim: Column) -> Column:
    """A point's place in the order along a dimension: coordinate, hash, number."""
    return F.struct(F.coalesce(F.get("c", dim), F.lit(0).cast("long")).alias("c"), F.col("t"), F.col("r"))


def table(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """Broadcast: a row for each node of a level, fewer than there are shards."""
    return F.broadcast(spark.createDataFrame(rows, kind))


def descended(rows: DataFrame, tree: Tree) -> DataFrame:
    """Points with node brought from the root to the leaf of the tree as far as it is grown."""
    for level in tree.levels:
        cuts = table(rows.sparkSession, [(n.number, n.dim, n.cut) for n in level], CUTS)
        side = F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(order(F.col("dim")) <= F.col("cut"), 0).otherwise(1))
        rows = rows.join(cuts, "node", "left").withColumn("node", side).drop("dim", "cut")
    return rows


def widest(here: DataFrame, docs: DataFrame, dims: tuple[str, ...], nodes: list[Node], whole: list[float]) -> list[Node]:
    """Nodes that have rows, with their size, the dimension in which they are widest, as a share of its whole breadth, and its
    range. Of dimensions equally wide the first counts."""
    ends = [g(F.get("c", F.lit(i))).alias(f"{n}{i}") for i in range(len(dims)) for n, g in (("lo", F.min), ("hi", F.max))]
    wide = [breadth(docs, d, F.col(f"lo{i}"), F.col(f"hi{i}")).alias(f"wide{i}") for i, d in enumerate(dims)]
    rows = {r["node"]: r for r in here.groupBy("node").agg(F.sum("size").alias("w"), *ends).select("*", *wide).collect()}
    out = []
    for n in nodes:
        if r := rows.get(n.number):
            dim = max(range(len(dims)), key=lambda i: (r[f"wide{i}"] / whole[i], -i), default=0)
            out.append(replace(n, size=r["w"], dim=dim, low=r[f"lo{dim}"] if dims else 0, high=r[f"hi{dim}"] if dims else 0))
    return out


def narrowed(here: DataFrame, open_: list[Node]) -> list[Node]:
    """One step of all nodes' searches: sizes are summed up by ranges of the next key, partially before the shuffle, and of each
    node only the range in which its boundary falls comes to the driver."""
    ranges = max(2, min(RANGES, COUNTS // len(open_)))
    asked = table(here.sparkSession, [(n.number, n.dim, n.stage, n.c, n.t, n.low, n.step(ranges), n.below, n.wanted) for n in open_], SPLITS)
    own = here.join(asked, F.col("node") == F.col("_n")).withColumn("k", order(F.col("dim")))
    settled = ((F.col("stage") < 1) | (F.col("k.c") == F.col("_c"))) & ((F.col("stage") < 2) | (F.col("t") == F.col("_t")))
    key = F.when(F.col("stage") == 0, F.col("k.c")).when(F.col("stage") == 1, F.col("t")).otherwise(F.col("r"))
    placed = own.where(settled).withColumn("v", key).where(F.col("v") >= F.col("low")).withColumn("b", F.expr("(v - low) div step")).where(F.col("b") < ranges)
    sums = placed.groupBy("node", "b", "below", "wanted").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("k").alias("k"))
    run = Window.partitionBy("node").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    reached = sums.withColumn("to", F.sum("w").over(run) + F.col("below"))
    met = reached.where(F.col("to") >= F.col("wanted")).groupBy("node").agg(F.min(F.struct("b", "to", "w", "n", "lo", "hi", "k")).alias("m"))
    rows = {r["node"]: r["m"] for r in met.collect()}
    out = []
    for n in open_:
        m = rows[n.number]
        below, k = m["to"] - m["w"], m["k"]
        if m["n"] == 1:
            # The row at the boundary goes to the side that it makes less uneven.
            left = 2 * below + m["w"] <= 2 * n.wanted
            out.append(replace(n, cut=(k["c"], k["t"], k["r"] - (not left))))
        elif m["lo"] < m["hi"]:
            out.append(replace(n, below=below, low=m["lo"], high=m["hi"]))
        else:
            # Many rows share this key: the next one decides. Its ends are the whole range of hashes or numbers.
            out.append(replace(n, below=below, stage=n.stage + 1, low=0, high=(1 << 60) - 1 if n.stage == 0 else (1 << 62) - 1, **({"c": m["lo"]} if n.stage == 0 else {"t": m["lo"]})))
    return out


def grown(rows: DataFrame, docs: DataFrame, dims: tuple[str, ...], shards: int) -> Tree:
    """The tree with `shards` leaves. A node of k leaves is split where k // 2 of k parts of its size lie on one side; jobs of a
    level serve all its nodes, and the driver keeps one row a node."""
    tree, todo = Tree(), [(Node(1, shards), 0)]
    ends = [breadth(docs, d, F.min(F.get("c", F.lit(i))), F.max(F.get("c", F.lit(i)))) for i, d in enumerate(dims)]
    whole = [max(1e-9, x) for x in rows.agg(*[e.alias(f"b{i}") for i, e in enumerate(ends)]).first()] if dims else []
    while todo:
        asked = [n for n, _ in todo if n.leaves > 1]
        open_ = widest(descended(rows, tree), docs, dims, asked, whole) if asked else []
        done: dict[int, Node] = {}
        while open_:
            step = narrowed(descended(rows, tree), open_)
            done |= {n.number: n for n in step if n.cut}
            open_ = [n for n in step if not n.cut]
        # A node of one shard, or without rows, is a leaf.
        tree.leaves += [(n.number, first) for n, first in todo if n.number not in done]
        sides = lambda n: ((0, n.leaves // 2, 0), (1, n.leaves - n.leaves // 2, n.leaves // 2))
        todo = [(Node(2 * n.number + side, leaves), first + more) for n, first in todo if n.number in done for side, leaves, more in sides(n)]
        if done:
            tree.levels.append(list(done.values()))
    return tree


def with_shard(rows: DataFrame, tree: Tree) -> DataFrame:
    leaves = table(rows.sparkSession, tree.leaves, "node bigint, shard int")
    return descended(rows, tree).join(leaves, "node").drop("node")


def planned(docs: DataFrame, dims: tuple[str, ...], shards: int, target_bytes: int | None, carry: bool) -> tuple[DataFrame, Tree]:
    """The rows' points, written once, and the tree over them. carry: whole rows go along, as a column that the search never reads."""
    rows = materialize(points(docs, dims, carry), "points")
    if target_bytes is not None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    return rows, grown(rows, docs, dims, shards)


def sharded(docs: DataFrame, shards: int = 8, dims: tuple[str, ...] = DIMS, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): each row of docs (doc_id, text and the columns `dims`) in one of
    `shards` shards, or of as many as hold target_bytes each. size: the text's bytes in UTF-8 and one more.

    Shards are leaves of a k-d tree. A node is split along the dimension in which it is widest, at the weighted median, found
    exactly by sums over ever narrower ranges; rows that share a place are parted by a hash, equal rows by their number, so
    that a third of all rows in one place makes no shard larger. A shard's size is off the mean by less than the largest row.
    Slots count a shard's rows from 0, by the hash; they come from one sort by ranges and running totals of its parts.

    Null texts have size 1, null ids and metadata count as values of their own, repeated rows count each; other columns are
    ignored; an empty table gives no rows. Results are the same in every partitioning, but for which of equal rows is which.
    """
    rows, tree = planned(docs, dims, shards, target_bytes, False)
    ordered = with_shard(rows, tree).select("doc_id", "size", "text_crc32", "shard", "t", "r").repartitionByRange("shard", "t", "r").sortWithinPartitions("shard", "t", "r")
    placed = materialize(ordered.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at")), "slots")
    discard(rows)
    parts = placed.groupBy("shard", F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    run = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("shard", "part", (F.coalesce(F.sum("n").over(run), F.lit(0)) - F.col("first")).alias("shift"))
    # As many rows as the sort had parts, and one more for each shard.
    found = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), ["shard", "part"])
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, dims: tuple[str, ...] = DIMS, target_bytes: int | None = None) -> str:
    """Writes whole rows of docs to a Parquet folder for each shard; returns the name of the column that tells the shard, which is
    `shard` with as many underscores before it as keep it apart from docs' own columns."""
    column = "shard"
    while column.lower() in {c.lower() for c in docs.columns}:
        column = f"_{column}"
    rows, tree = planned(docs, dims, shards, target_bytes, True)
    ordered = with_shard(rows, tree).repartitionByRange("shard", "t", "r")
    ordered.select("row.*", F.col("shard").alias(column)).write.partitionBy(column).mode("overwrite").parquet(path)
    discard(rows)
    return column
