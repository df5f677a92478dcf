"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Words whose counts a Python worker remembers before it starts afresh.
MEMO = 1_000_000
MARK = "▁"
RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCounter:
    """Counts tokens as a SentencePiece BPE model with byte fallback and an identity normaliser gives them.

    The text gets a mark in front, and a mark for each space. No piece has a mark after another character, so merges never
    cross from one run `marks, other characters` to the next: runs are counted alone, and remembered.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in own}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("the vocabulary has pieces that reach over a space")
        joined = {c for p in self.rank if len(p) > 1 for c in p}
        #: Characters of no longer piece can't merge: they part a run.
        self.parts = re.compile("[" + re.escape("".join(sorted(joined))) + "]+|.", re.DOTALL)
        self.memo: dict[str, int] = {}

    def run(self, run: str) -> int:
        """Initial symbols minus merges; a symbol outside the vocabulary counts its UTF-8 bytes instead."""
        return sum(self.merged(p) if len(p) > 1 else 1 if p in self.rank else len(p.encode("utf-8", "replace")) for p in self.parts.findall(run))

    def merged(self, text: str) -> int:
        rank, n = self.rank, len(text)
        at: list[str | None] = list(text)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, text[i : i + 2]) for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i] if at[i] is not None else -1
            if j < 0 or at[i] + at[j] != pair:
                continue  # one of the two has merged meanwhile
            at[i], at[j] = pair, None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank.get(pair + at[k])) is not None:
                    heapq.heappush(heap, (r, i, pair + at[k]))
            if (h := left[i]) >= 0 and (r := rank.get(at[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, at[h] + pair))
        return sum(1 if s in rank else len(s.encode("utf-8", "replace")) for s in at if s is not None)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if text[0] == " " or "  " in text or MARK in text:
            runs = RUNS.findall(MARK + text.replace(" ", MARK))
        else:
            runs = text.split(" ")  # each has one mark in front; it is added when the run is new
        memo, total = self.memo, 0
        for r in runs:
            n = memo.get(r)
            if n is None:
                n = self.run(r if r[:1] == MARK else MARK + r)
                if len(memo) >= MEMO:
                    memo.clear()
                if len(r) <= 200:
                    memo[r] = n
            total += n
        return total


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs; needs only doc_id and text.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. A text of any length is counted whole.
    model_file has to lie at the same path on all executors.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_file)
        for b in batches:
            texts = b.column("text").to_pylist()
            tokens = [counter.count(t) for t in texts]
            sizes = [len(t.encode("utf-8", "replace")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
