"""Spans of text: found by patterns, made disjoint, masked. All in array functions, without a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private characters that mark a match; in a text they count as blanks.
OPEN, SHUT = "\uf8f0", "\uf8f1"
SPAN = "array<struct<start:int,end:int,text:string>>"


def bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def unmarked(text: Column) -> Column:
    """A text without the two private characters that mark matches; they count as blanks."""
    return F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(SHUT)), F.translate(text, OPEN + SHUT, "  ")).otherwise(text)


#: Matches of a block; arrays that grow by one are copied each time, so they grow in blocks.
BLOCK = 64


def find(text: Column, pattern: str) -> Column:
    """All matches of a pattern that do not overlap, left to right: start, end (code points, half open), text.

    The matches are marked in the text by one replacement, so that assertions see their real surroundings, and counted off:
    first block by block, then in each block, so that a text of many matches takes time in proportion to them. The two private
    characters that mark matches count as blanks where a text has them itself.
    """
    plain = unmarked(text)
    parts = F.split(F.regexp_replace(plain, pattern, f"{OPEN}$0{SHUT}"), OPEN)

    def spans(p: Column) -> Column:
        n = F.size(p) - 1
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).bitwiseAND(~(BLOCK - 1)), F.lit(BLOCK)), lambda b: F.slice(p, b + 2, BLOCK))
        total = lambda block: F.aggregate(block, F.lit(0), lambda a, seg: a + F.length(seg) - 1)
        first = F.struct(F.length(F.get(p, F.lit(0))).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = lambda bs: F.aggregate(bs, first, lambda acc, b: F.struct((acc["at"] + total(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

        def step(acc: Column, seg: Column) -> Column:
            word = F.substring_index(seg, SHUT, 1)
            span = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(word)).alias("end"), word.alias("text"))
            return F.struct((acc["at"] + F.length(seg) - 1).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        def inside(block: Column, at: Column) -> Column:
            return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

        return bind(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(bs), inside)))

    return F.when(plain.rlike(pattern), bind(parts, spans)).otherwise(F.array().cast(SPAN))


def marked(plain: Column, pattern: str) -> Column:
    """A text of unmarked() with all matches marked; null if there is none. counted() tells where they are."""
    return F.when(plain.rlike(pattern), F.regexp_replace(plain, pattern, f"{OPEN}$0{SHUT}"))


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    """Strings of these numbers of bytes, one after the other."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(size, row, start, end, match) of texts of marked(), inside a task: how many characters each has without marks, and of each match
    its text's row, its first character and the one behind its last, and itself. Nulls are empty."""
    texts = texts.cast(pa.string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before a byte
    marks = np.flatnonzero(data == OPEN.encode()[0])
    marks = marks[data[marks + 1] == OPEN.encode()[1]]
    first, last = (marks[data[marks + 2] == m.encode()[2]] for m in (OPEN, SHUT))
    row = np.searchsorted(at, first, "right") - 1
    count = np.bincount(row, minlength=len(texts))
    earlier = before[at[row]] + 2 * (np.arange(len(row)) - (np.cumsum(count) - count)[row])
    sizes = last - first - 3
    inside = np.repeat(first + 3 - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return np.diff(before[at]) - 2 * count, row, before[first] - earlier, before[last] - earlier - 1, strings(data[inside], sizes)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def greedy_disjoint(spans: Column, kind: str) -> Column:
    """Takes spans in order and keeps each that overlaps none kept before. kind: the array's type."""
    return F.aggregate(spans, F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: overlap(x, k)), kept).otherwise(F.concat(kept, F.array(x))))


def mask(text: Column, spans: Column, by: str = "[UNK]", leak_nested: bool = False) -> Column:
    """The text with each span, in order of start, replaced; white space is collapsed. Nested spans repeat text if leak_nested."""
    kind = "struct<at:int,out:string>"

    def step(acc: Column, s: Column) -> Column:
        end = s["end"] if leak_nested else F.greatest(acc["at"], s["end"])
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        put = F.lit(by) if leak_nested else F.when(s["end"] > acc["at"], F.lit(by)).otherwise(F.lit(""))
        return F.struct(end.alias("at"), F.concat(acc["out"], gap, put).alias("out")).cast(kind)

    ordered = F.array_sort(spans)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind)
    whole = F.aggregate(ordered, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.btrim(F.regexp_replace(whole, r"\s+", " "))
