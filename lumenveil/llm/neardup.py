"""Near-duplicate groups by a chosen-path set similarity join."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialize, mix, row_key, small_batches, word_hashes

#: Lower-cases A-Z in UTF-8.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Sets of a node that are compared with as many others in one cell.
CELL = 32
LOWER_BYTES = np.frombuffer(LOWER, np.uint8)
#: Longs of a set's parity bits.
ODD = 8
#: What is known of a set without its text: two-bit minwise sketch, size, parity bits.
SKETCH = ["b0", "b1", "n_set", *[f"o{i}" for i in range(ODD)]]


@dataclass(frozen=True)
class Join:
    """width: words in a shingle. least: similarity in hundredths that links two sets. trees: independent trees, each with a
    coordinate of its own at the root. small: up to so many sets, all pairs of a node are held against each other's sketches;
    tiny: up to so many, in Spark's own functions. early: coordinates that the first levels of a larger node follow, once it is parted by sizes; later
    levels follow `1 / similarity` on average, the chosen-path rate, so that sets below the threshold die out. deepest: levels at most. coords: minwise tokens of a set. far: sketches of two sets
    that are linked differ in at most so many of `coords` two-bit places (at similarity 0.8, 27 of 64 leave out 5 in 10**7). Sizes
    and parity bits of two sets leave out no link: see close()."""

    width: int = 2
    least: int = 80
    trees: int = 12
    small: int = 1000
    tiny: int = 24
    early: tuple[int, ...] = (3, 2, 2)
    deepest: int = 40
    coords: int = 64
    far: int = 27


def shingles(text: str | None, width: int) -> set[bytes]:
    words = text.encode("utf-8", "replace").translate(LOWER).split() if text else []
    if not words:
        return set()
    if len(words) < width:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))  # noqa: B905


def signer(config: Join):
    """For each row: number of shingles, digest of the whole set, minwise tokens (8 bytes each), their sketch (two longs), and
    the set's parity bits: shingles are dealt to 64 * ODD bits, and each holds whether their number is odd."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, config.coords + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for b in batches:
            sizes, digests, tokens, bits = [], [], [], []
            odd = np.zeros((b.num_rows, ODD), np.int64)
            for (h,) in word_hashes(b.column("text"), LOWER_BYTES):
                if not len(h):
                    sizes.append(0)
                    digests.append(None)
                    tokens.append(None)
                    bits.append((None, None))
                    continue
                n, s = max(1, len(h) - config.width + 1), np.zeros(max(1, len(h) - config.width + 1), np.uint64)
                for k in range(min(config.width, len(h))):
                    s = mix(s + h[k : k + n] + np.uint64(k))
                s = np.unique(s)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.astype("<u8").tobytes() + bytes([len(h) < config.width]), digest_size=16).digest())
                low = np.full(config.coords, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(s), 512):  # stays in the processor's cache
                    x = (s[at : at + 512, None] ^ salts) * np.uint64(0x9FB21C651E98DF25)
                    x ^= x >> np.uint64(32)
                    x *= np.uint64(0xD6E8FEB86659FD93)
                    np.minimum(low, x.min(axis=0), out=low)
                tokens.append(low.astype("<u8").tobytes())
                odd[len(sizes) - 1] = np.packbits((np.bincount((s & np.uint64(64 * ODD - 1)).astype(np.int64), minlength=64 * ODD) & 1).astype(np.uint8)).view(np.int64)
                spread = mix(low)
                bits.append(tuple(int(np.packbits(((spread >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)).view(">i8")[0]) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.binary()), pa.array([x for x, _ in bits], pa.int64()), pa.array([x for _, x in bits], pa.int64()), *[pa.array(odd[:, i]) for i in range(ODD)]], names=["doc_id", "key", "n_shingles", "digest", "tokens", "b0", "b1", *SKETCH[3:]])

    return signed


def close(config: Join, left: str = "", right: str = "other."):
    """Two sets may be linked, by their sketches, sizes and parity bits.

    Linked sets of n and m members differ in at most (n + m) * (100 - least) / (100 + least) members, and each of these turns
    one parity bit: two that differ in more bits are not linked, whatever their texts."""
    a, b = ({x: F.col(f"{side}{x}") for x in SKETCH} for side in (left, right))
    differ = a["b0"].bitwiseXOR(b["b0"]).bitwiseOR(a["b1"].bitwiseXOR(b["b1"]))
    odd = reduce(lambda x, y: x + y, [F.bit_count(a[x].bitwiseXOR(b[x])) for x in SKETCH[3:]])
    like = 100 * F.least(a["n_set"], b["n_set"]) >= config.least * F.greatest(a["n_set"], b["n_set"])
    return (F.bit_count(differ) <= config.far) & like & ((100 + config.least) * odd <= (100 - config.least) * (a["n_set"] + b["n_set"]))


def verified(pairs: DataFrame, texts: DataFrame, config: Join) -> DataFrame:
    """Those of pairs (a, b, cell), each there once, whose full sets of shingles, as words, are similar enough.

    Pairs come in cells of some tens of sets: each set's text is sent to a cell once, however many pairs it has there, and
    parted into words once. A worker holds one cell at a time."""

    def judged(cell: list[tuple[bytes, list[bytes], str]]) -> list[tuple[bytes, bytes]]:
        sets = {digest: shingles(text, config.width) for digest, _, text in cell}
        out = []
        for digest, mates, _ in cell:
            for mate in mates:
                x, y = sets[mate], sets[digest]
                if 100 * min(len(x), len(y)) >= config.least * max(len(x), len(y)):
                    common = len(x & y)
                    if common and 100 * common >= config.least * (len(x) + len(y) - common):
                        out.append((mate, digest))
        return out

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[tuple[bytes, list[bytes], str]] = []
        for b in batches:
            linked = []
            for cell, *row in zip(*(b.column(c).to_pylist() for c in ("cell", "digest", "mates", "text")), strict=True):
                if cell != now:
                    linked += judged(held)
                    now, held = cell, []
                held.append(tuple(row))
            yield as_batch(linked)
        yield as_batch(judged(held))

    def as_batch(linked: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in linked], pa.binary()) for i in (0, 1)], names=["a", "b"])

    ends = pairs.select("cell", F.col("b").alias("digest"), F.col("a").alias("mate")).union(pairs.select("cell", "a", F.lit(None).cast("binary")))
    ends = ends.groupBy("cell", "digest").agg(F.collect_list("mate").alias("mates"))
    rows = ends.join(texts, "digest").select("cell", "digest", "mates", "text").repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(confirmed, "a binary, b binary")


def groups(docs: DataFrame, config: Join = Join()) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, stays): a row for each row of docs (doc_id, text); component_id is the least
    doc_id that links lead to, key is row_key() of the row, and stays holds for a component's least (doc_id, key).

    Rows with equal sets are one class from the start. Each class enters each tree's node by its minwise token there.
    In a node every class is held against the node's least class first; classes that this links into one component need no
    more comparison, so a node of thousands of near copies costs a pass and not its square. What is left of a node is compared
    exhaustively if it is small, or if one component has all its sets but a few, and otherwise is parted by sizes first, which loses nothing, and then branches by further minwise tokens; after `deepest` levels, whatever its size. Each link is confirmed on whole texts.
    A pair of similarity s shares a root node with probability s in each tree: at 0.8 and 12 trees, 4 in 10**9 share none.

    Texts that are null or without words have no shingles and are alone; a row's ids may repeat (rows of equal text are
    linked, as any others); an empty table gives no rows. Ties go to the least doc_id; null ids count as the largest.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").withColumn("key", row_key())
    signed = materialize(rows.mapInArrow(signer(config), "doc_id long, key long, n_shingles long, digest binary, tokens binary, b0 long, b1 long, " + ", ".join(f"{x} long" for x in SKETCH[3:])), "near-signed")
    classes = materialize(signed.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("row"), F.first("tokens").alias("tokens"), *[F.first("n_shingles" if x == "n_set" else x).alias(x) for x in SKETCH]), "near-classes")
    token = lambda i: F.substring("tokens", 8 * i + 1, 8)
    nodes = classes.select("digest", *SKETCH, F.posexplode(F.array(*[token(i) for i in range(config.trees)])).alias("tree", "t")).select(F.xxhash64("tree", "t").alias("node"), "digest", *SKETCH)
    root: DataFrame | None = None
    last: DataFrame | None = None  # the table that the level's nodes come from
    for depth in range(config.deepest):
        size = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("digest", *SKETCH)).alias("other")).where("n > 1")
        size = materialize(size, "near-sizes")  # so that the join can split a hot node
        live = materialize(with_root(nodes.join(size, "node"), root), "near-nodes")
        discard(size, last)
        if not live.head(1):
            discard(live)
            break
        star = live.where((F.col("digest") != F.col("other.digest")) & close(config)).select(F.col("digest").alias("a"), F.col("other.digest").alias("b"), "root", F.xxhash64("other.digest", F.pmod(F.xxhash64("digest"), F.ceil(F.col("n") / CELL))).alias("cell"))
        if root is not None:
            star = star.join(root.select(F.col("id").alias("b"), F.col("root").alias("its")), "b", "left").where("root <> coalesce(its, b)")
        star = materialize(star.groupBy("a", "b").agg(F.min("cell").alias("cell")), "near-star")
        tiny = live.where(F.col("n").between(3, config.tiny)).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("digest", *SKETCH, "root"))).alias("m"))
        open_ = tiny.where(F.exists("m", lambda x: x["root"] != F.col("m")[0]["root"]))
        first = open_.select("node", F.explode("m").alias("x"), "m").select("node", "x.*", F.explode(F.filter("m", lambda y: (y["digest"] > F.col("x.digest")) & (y["root"] != F.col("x.root")))).alias("other"))
        pairs = first.where(close(config)).groupBy(F.col("other.digest").alias("a"), F.col("digest").alias("b")).agg(F.min("node").alias("cell"))
        pairs = materialize(pairs.join(star, ["a", "b"], "left_anti"), "near-pairs")
        texts = texts_of(star.union(pairs), classes, rows)
        root = linked([(star, texts)], root, config)
        rooted = with_root(live.where(F.col("n") > config.tiny).drop("root"), root)
        # A node whose sets are all of one component but for `small` at most needs no branching, however large it is.
        shares = rooted.groupBy("node", "root").agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("others")).where("others > 0")
        rooted = materialize(rooted.join(shares, "node").select("node", "digest", *SKETCH, "n", "root", "main", "others"), "near-mixed")
        last = rooted
        middle = rooted.where((F.col("n") <= config.small) | (F.col("others") <= config.small))
        blocks = materialize(in_blocks(middle, config), "near-blocks")
        # The nearest sets of each two components first: what these links join needs no more pairs.
        nearest = candidates(blocks, config, True)
        more = texts_of(nearest, classes, rows)
        root = linked([(pairs, texts), (nearest, more)], root, config)
        if more is not None:
            rest = with_root(blocks.drop("root"), root)
            apart = rest.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("node")
            others = materialize(candidates(rest.join(apart, "node", "left_semi"), config, False).join(nearest, ["a", "b"], "left_anti"), "near-pairs")
            last_texts = texts_of(others, classes, rows)
            root = linked([(others, last_texts)], root, config)
            discard(others, last_texts)
        discard(star, pairs, nearest, blocks, texts, more, live)
        wide = rooted.where((F.col("n") > config.small) & (F.col("others") > config.small)).select("node", "digest", *SKETCH)
        if depth == 0:
            grown = wide.select("node", "digest", *SKETCH, F.explode(size_cells(config)).alias("i"))
            nodes = grown.select(F.xxhash64("node", "i").alias("node"), "digest", *SKETCH)
            continue
        rate = F.lit(config.early[depth - 1]) if depth <= len(config.early) else F.lit(100 // config.least) + (F.pmod(F.xxhash64("node", F.lit("rate")), F.lit(config.least)) < 100 % config.least).cast("int")
        picks = F.transform(F.sequence(F.lit(1), rate), lambda k: F.pmod(F.xxhash64("node", k), F.lit(config.coords)).cast("int"))
        grown = wide.join(classes.select("digest", "tokens"), "digest")
        grown = grown.select("node", "digest", *SKETCH, "tokens", F.explode(F.array_distinct(picks)).alias("i"))
        nodes = grown.select(F.xxhash64("node", "i", F.expr("substring(tokens, 8 * i + 1, 8)")).alias("node"), "digest", *SKETCH)
    else:  # what the levels have not parted: all pairs of a node that no links join
        rest = with_root(nodes, root)
        mixed = rest.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("node")
        rest = materialize(rest.join(mixed, "node", "left_semi"), "near-last")
        other = rest.select("node", F.struct("digest", *SKETCH).alias("other"), F.col("root").alias("its"))
        pairs = rest.join(other, "node").where((F.col("digest") > F.col("other.digest")) & (F.col("root") != F.col("its")) & close(config))
        cell = F.xxhash64("node", F.shiftright("b0", 56), F.shiftright("other.b0", 56))
        pairs = materialize(pairs.groupBy(F.col("digest").alias("a"), F.col("other.digest").alias("b")).agg(F.min(cell).alias("cell")), "near-pairs")
        root = linked([(pairs, texts_of(pairs, classes, rows))], root, config)
    members = signed.select("doc_id", "key", "n_shingles", "digest")
    if root is not None:
        members = members.join(root.withColumnRenamed("id", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    else:
        members = members.withColumn("root", F.col("digest"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    least = members.where("root is not null").groupBy("root").agg(F.min(place).alias("least"))
    stays = F.col("least").isNull() | (place == F.col("least"))
    return members.join(least, "root", "left").select("doc_id", "key", "n_shingles", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), stays.alias("stays"))


def texts_of(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(digest, text) for the ends of pairs; none if there are no pairs."""
    if not pairs.head(1):
        return None
    need = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct().join(classes.select("digest", "row"), "digest")
    need = materialize(need.select("digest", F.coalesce("row.doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("row.key").alias("_key")), "near-need")
    own = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("key").alias("_key"), "text")
    texts = materialize(own.join(need, ["_id", "_key"]).select("digest", "text").dropDuplicates(["digest"]), "near-texts")
    discard(need)
    return texts


def linked(some: list[tuple[DataFrame, DataFrame | None]], root: DataFrame | None, config: Join) -> DataFrame | None:
    """Components with those of the pairs that hold and are not in one component yet; some: pairs with their texts."""
    found = [materialize(verified(pairs if root is None else apart_only(pairs, root), texts, config), "near-links") for pairs, texts in some if texts is not None]
    new = [x for x in found if x.head(1)]
    if new:
        root, before = components(reduce(DataFrame.union, new), "near", root), root
        discard(before)
    discard(*found)
    return root


def size_cells(config: Join):
    """The two cells that a set of n_set members is in: a step of sizes and the next. Sizes of linked sets are less than a step
    apart, so each two linked sets share a cell; a step is a little wider than they can be, for rounding."""
    step = F.floor(F.log("n_set") / (math.log(100 / config.least) * 1.0001))
    return F.array(step, step + 1)


def in_blocks(rows: DataFrame, config: Join) -> DataFrame:
    """(node, digest, sketch, root): nodes of over `small` sets in blocks of about so many of the main component's sets; the
    others, `small` of them at most, are in each block, so that they are held against every set. As many rows again at most."""
    own = ["node", "digest", *SKETCH, "root"]
    blocks = F.ceil(F.col("n") / config.small)
    at = F.when(F.col("root") == F.col("main"), F.array(F.pmod(F.xxhash64("digest"), blocks))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
    large = rows.where(F.col("n") > config.small).select(*own, F.explode(at).alias("block")).withColumn("node", F.xxhash64("node", "block"))
    return rows.where(F.col("n") <= config.small).select(*own).union(large.select(*own))


def candidates(blocks: DataFrame, config: Join, nearest: bool) -> DataFrame:
    """(a, b, cell): the pairs that within() finds, each once."""
    held = blocks.repartition("node").sortWithinPartitions("node")
    return materialize(held.mapInArrow(within(config, nearest), "a binary, b binary, cell long").groupBy("a", "b").agg(F.min("cell").alias("cell")), "near-pairs")


def within(config: Join, nearest: bool):
    """All pairs of each node or block with close sketches and different roots, or `nearest`, for each two roots there the pair
    whose parity bits differ least; rows come sorted by node, about twice `small` of one at most: tens of MB in a worker, however
    long their texts."""

    def compared(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        node = t["node"].to_numpy()
        cut = np.flatnonzero(np.diff(node)) + 1
        x, y = (t[c].to_numpy().view(np.uint64) for c in ("b0", "b1"))
        n, odd = t["n_set"].to_numpy(), np.stack([t[c].to_numpy().view(np.uint64) for c in SKETCH[3:]], axis=1)
        root = pa.compute.dictionary_encode(t["root"].combine_chunks()).indices.to_numpy()
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        cells: list[np.ndarray] = [np.zeros(0, np.uint64)]
        found: list[tuple[np.ndarray, ...]] = []
        for lo, hi in zip([0, *cut], [*cut, len(node)], strict=True):
            for i in range(lo, hi - 1):
                far = np.bitwise_count((x[i] ^ x[i + 1 : hi]) | (y[i] ^ y[i + 1 : hi]))
                sizes = n[i + 1 : hi]
                like = 100 * np.minimum(sizes, n[i]) >= config.least * np.maximum(sizes, n[i])
                j = np.flatnonzero((far <= config.far) & like & (root[i + 1 : hi] != root[i])) + i + 1
                bits = np.bitwise_count(odd[j] ^ odd[i]).sum(axis=1, dtype=np.int64)
                may = (100 + config.least) * bits <= (100 - config.least) * (n[j] + n[i])
                j, bits = j[may], bits[may]
                if len(j):
                    found.append((j, np.full(len(j), i), bits))
            if not found:
                continue
            j, i, bits = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            if nearest:
                one, two = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
                order = np.lexsort((bits, two, one))
                first = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])
                j, i = j[order[first]], i[order[first]]
            a.append(j)
            b.append(i)
            cells.append(mix(node.view(np.uint64)[lo] ^ mix(((i - lo) // CELL * (1 << 20) + (j - lo) // CELL + 1).astype(np.uint64))))
        digest = t["digest"].combine_chunks()
        take = lambda at: digest.take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64)))
        p, q = take(a), take(b)
        swap = pa.compute.less(p, q)  # each pair in one order only
        return pa.RecordBatch.from_arrays([pa.compute.if_else(swap, q, p), pa.compute.if_else(swap, p, q), pa.array(np.concatenate(cells).view(np.int64))], names=["a", "b", "cell"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            node = b.column("node").to_numpy()
            if node[0] != node[-1]:  # all nodes but the last are complete
                last = int(np.flatnonzero(node != node[-1])[-1]) + 1
                yield compared([*held[:-1], b.slice(0, last)])
                held = [b.slice(last)]
        if held:
            yield compared(held)

    return pairs


def with_root(rows: DataFrame, root: DataFrame | None) -> DataFrame:
    if root is None:
        return rows.withColumn("root", F.col("digest"))
    return rows.join(root.withColumnRenamed("id", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))


def apart_only(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """Pairs whose two ends links don't join yet."""
    for end in ("a", "b"):
        pairs = pairs.join(root.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.where("root_a <> root_b").drop("root_a", "root_b")


def near_duplicates(docs: DataFrame, config: Join = Join()) -> DataFrame:
    """groups() with kept: whether the row's doc_id is its component's."""
    return groups(docs, config).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_copies(docs: DataFrame, config: Join = Join()) -> DataFrame:
    """Rows of docs, all columns, one of each component: its least (doc_id, key), once. Texts without words all stay."""
    doc, key = (f"_{x}{uuid.uuid4().hex}" for x in ("doc", "key"))  # names that docs can't have
    keep = groups(docs, config).where("stays").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(doc), F.col("key").alias(key))
    rows = docs.withColumn(doc, F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn(key, row_key())
    return rows.join(keep, [doc, key], "left_semi").dropDuplicates([doc, key]).select(*[F.col(f"`{c}`") for c in docs.columns])
