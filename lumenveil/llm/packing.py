"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: A run of white space that a backtracking pattern would not get through.
LONG_SPACE = re.compile(r"\s{2000}")
#: How byte-level BPE parts a text before merging; a fixed value of the format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Limits of the query and of the pipeline, beside tokens. Segments bind only where texts have fewer than four tokens on average,
#: loss in sequences of one or two pieces.
PRODUCTION = {"max_segments": 512, "max_loss": 2046}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Identifiers as the tokenizers library gives them for a byte-level BPE file.

    tiktoken merges the same ranks several times faster, and encodes all texts that hold no special token; the ranks are
    read from the file itself. Where a special token stands in a text, the library's own handling counts, and it encodes.
    """

    def __init__(self, tokenizer_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        byte_of = {c: b for b, c in enumerate(printable())}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in self.own.get_vocab(with_added_tokens=False).items() if piece not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if any(s in text for s in self.special) or LONG_SPACE.search(text):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(tokenizer_file)


def printable() -> list[str]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable ones of Latin-1 as they are, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def pieces_of(docs: DataFrame, tokenizer_file: str, size: int, end_id: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, salt = encoder(tokenizer_file), 0
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(own.ids(text), np.uint32(end_id))
                raw = memoryview(ids.tobytes())
                for start in range(0, len(ids), size):
                    n = min(size, len(ids) - start)
                    salt += 1
                    rows.append((doc_id, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), len(ids), n - (start == 0), salt))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss", "salt"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def place(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, by the dot-product heuristic: one bin is open, and of the items that fit it takes the one
    with the largest weighted product of its demand and the room left; ties go to the first. Column 0 of demand is tokens."""
    n = len(demand)
    scaled = demand / limits
    weight = scaled.mean(axis=0) if n else np.zeros(demand.shape[1])
    order = np.lexsort((np.arange(n), *(-demand.T[::-1])))  # largest first, so that equal products go to the larger
    left, scaled = demand[order], scaled[order]
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    number = 0
    while len(order):
        room, used = limits.astype(float).copy(), 0
        alive = np.ones(len(order), bool)
        fits = (left <= room).all(axis=1)
        if not fits.any():
            raise ValueError("an item is larger than a bin")
        while fits.any():
            at = int(np.argmax(np.where(fits, scaled @ (weight * room / limits), -1.0)))
            where[order[at]], offset[order[at]] = number, used
            used += int(left[at, 0])
            room -= left[at]
            alive[at] = False
            fits &= alive
            fits &= (left <= room).all(axis=1)
        order, left, scaled = order[alive], left[alive], scaled[alive]
        number += 1
    return where, offset


def pack(docs: DataFrame, tokenizer_file: str, size: int = 2048, max_segments: int = 128, max_loss: int | None = None, end_id: int = 1, block: int = 8192, sequences: int = 1024) -> DataFrame:
    """Packs all rows of docs (doc_id, text) into sequences of at most `size` tokens, `max_segments` pieces and `max_loss`
    loss-bearing tokens (of each document all but its first; None: as many as tokens).

    A document longer than a sequence is cut each `size` tokens; its rest is placed with others. Pieces are dealt by a salted
    hash into blocks of about `sequences` sequences' tokens, but no more than `block` pieces, and each block is packed alone, so
    that no task grows with the corpus, and only a block's last sequence is short for want of pieces. sequence_id is unique over all blocks; offsets in a sequence have no gap.
    Null and empty texts are one end_id. Repeated rows and ids are packed each. An empty table gives no rows; other columns are
    ignored. Which pieces share a block depends on how the table is partitioned, whether they fit does not.
    """
    small_batches(docs.sparkSession)
    if max_loss is not None and max_loss < size:
        cut_at = max_loss
    else:
        cut_at = size
    limits = np.array([size, max_segments, max_loss or size], float)
    pieces = materialize(pieces_of(docs, tokenizer_file, cut_at, end_id), "pieces")
    n, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-tokens // (sequences * size)))
    wide = 1 << 32

    def packed(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "doc_id", "start", "ids_crc32", "salt"]).reset_index(drop=True)
        demand = np.column_stack([items["length"], np.ones(len(items)), items["loss"]]).astype(float)
        where, offset = place(demand, limits)
        items["sequence_id"], items["offset"] = items["block"] * wide + where, offset
        return items[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(packed, PACKED)
