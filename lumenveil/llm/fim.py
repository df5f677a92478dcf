"""Fill-in-middle examples: texts cut at two ranks, found by counting boundaries in overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, small_batches

#: Marks of prefix, suffix and middle. None of them can begin inside another, so an output is taken apart in one way only.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk.
CHUNK = 4096
#: Bytes whose predicates are computed at once.
SLAB = 1 << 20
CUTS = "struct<n:bigint,first:bigint,second:bigint,first_byte:bigint,second_byte:bigint>"

#: Whether a unit begins at a byte, by the byte and the one before it. A text's first byte always begins one.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "character": lambda before, own: (own & 0xC0) != 0x80,
    "word": lambda before, own: SPACES[before] & ~SPACES[own],
    "line": lambda before, own: before == 0x0A,
}


class Chunks:
    """The texts of an Arrow column as chunks of bytes, each overlapping the one before by a byte.

    counts(): boundaries of all chunks, slab by slab, without keeping which bytes they are; a prefix sum over them tells each
    rank's chunk, and only such chunks are scanned again."""

    def __init__(self, column: pa.Array, unit: str, chunk: int = CHUNK):
        column = pc.fill_null(column, "").cast(pa.large_string())
        self.places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.begins = UNITS[unit]
        lengths = np.diff(self.places)
        each = -(-lengths // chunk)
        self.first = np.concatenate([[0], np.cumsum(each)])  # of each text's chunks
        number = np.arange(self.first[-1]) - np.repeat(self.first[:-1], each)
        self.start = np.repeat(self.places[:-1], each) + number * chunk
        self.end = np.minimum(self.start + chunk, np.repeat(self.places[1:], each))
        self.opens = number == 0
        self.before = np.concatenate([[0], np.cumsum(self.counts())])
        self.n = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def boundaries(self, lo: int, hi: int) -> np.ndarray:
        """Predicates of the bytes lo..hi; the byte before lo is looked at as well."""
        own = self.raw[lo:hi]
        return self.begins(self.raw[lo - 1 : hi - 1] if lo else np.concatenate([own[:1], own[:-1]]), own)

    def counts(self) -> np.ndarray:
        out, at = np.zeros(len(self.start), np.int64), 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + SLAB, "right")))
            lo = int(self.start[at])
            found = self.boundaries(lo, int(self.end[to - 1]))
            found[self.start[at:to][self.opens[at:to]] - lo] = True
            out[at:to] = np.add.reduceat(found, self.start[at:to] - lo, dtype=np.int64)
            at = to
        return out

    def cut(self, text: int, rank: int) -> int:
        """How many bytes of a text lie before its unit of that rank; all of them if there is none."""
        if rank >= self.n[text]:
            return int(self.places[text + 1] - self.places[text])
        wanted = self.before[self.first[text]] + rank
        k = int(np.searchsorted(self.before, wanted, "right")) - 1
        found = self.boundaries(int(self.start[k]), int(self.end[k]))
        found[0] |= self.opens[k]
        return int(self.start[k] + np.flatnonzero(found)[wanted - self.before[k]] - self.places[text])


def cuts(unit: str = "character", chunk: int = CHUNK) -> Callable[..., Column]:
    """A function of (text, h, g): the units of a text, the ranks h and g modulo one more than these, the lesser first, and the
    bytes before each. Where h is null only the units are counted."""

    @F.arrow_udf(CUTS)
    def found(text: pa.Array, h: pa.Array, g: pa.Array) -> pa.Array:
        chunks, rows = Chunks(text, unit, chunk), []
        for i, (x, y) in enumerate(zip(h.to_pylist(), g.to_pylist(), strict=True)):
            n = int(chunks.n[i])
            if x is None or y is None:
                rows.append((n, None, None, None, None))
            else:
                a, b = sorted((x % (n + 1), y % (n + 1)))
                rows.append((n, a, b, chunks.cut(i, a), chunks.cut(i, b)))
        names = ["n", "first", "second", "first_byte", "second_byte"]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=names)

    return found


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four whole numbers below 2**32 from the hash of seed and id; a null id counts as an empty one."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rearranged(docs: DataFrame, unit: str = "character", seed: int = 1, plain: int = 10, spm: int = 20, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) for each row of docs (doc_id, text), by a map without a shuffle.

    A text has n units; two ranks drawn from the id cut it into prefix, middle and suffix, any of which may be empty. form: `plain`
    (the text itself) for empty texts, texts that hold a mark, and `plain` of 100 ids; else `spm` (suffix first) for `spm` of
    100, else `psm`. Null texts are empty ones; rows that repeat are cut alike; null ids count as an empty id; other columns
    are ignored. A text of any length is counted chunk by chunk; a rank's chunk alone is scanned again.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (h3 % 100 >= 100 - plain), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    drawn = docs.select("doc_id", text.alias("text"), form.alias("form"), h1.alias("h"), h2.alias("g"))
    cut = lambda x: F.when(F.col("form") != "plain", x)
    found = drawn.select("doc_id", "text", "form", cuts(unit, chunk)("text", cut(F.col("h")), cut(F.col("g"))).alias("c")).select("doc_id", "text", "form", "c.*")
    whole = F.encode("text", "utf-8")
    part = lambda lo, hi: F.substring(whole, lo + 1, (hi if hi is not None else F.octet_length("text")) - lo).cast("string")
    a, b = F.col("first_byte").cast("int"), F.col("second_byte").cast("int")
    prefix, middle, suffix = part(F.lit(0), a), part(a, b), part(b, None)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    return found.select("doc_id", "n", "form", F.col("first").alias("prefix_units"), (F.col("second") - F.col("first")).alias("middle_units"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of rearranged() was made from."""
    inside = lambda lo, hi: F.substring_index(F.substring_index(output, lo, -1), hi, 1)
    psm = F.concat(inside(PREFIX, SUFFIX), F.substring_index(output, MIDDLE, -1), inside(SUFFIX, MIDDLE))
    spm = F.concat(inside(PREFIX, MIDDLE), F.substring_index(output, MIDDLE, -1), inside(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
