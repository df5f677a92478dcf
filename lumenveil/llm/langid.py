"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASES, discard, materialize, mix, prefix_sums, small_batches, stretch

MARK = "▁"
#: Words that a Python worker remembers, and numbers that it holds for them: 32 MB, whatever the number of languages.
MEMO, MEMO_CELLS = 200_000, 1 << 22
LETTER = regex.compile(r"\p{L}")
#: A character outside the vocabulary has this probability in every language.
UNKNOWN = 1e-7
#: The last model's word scores stay in a Python worker from task to task.
_HELD: dict[str, tuple[dict[str, int], list[np.ndarray], Vocabulary]] = {}


def pieces_of(model_file: str) -> dict[str, int]:
    """The vocabulary: pieces without control, byte and unknown ones, each with a column."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return {p: k for k, p in enumerate(dict.fromkeys(model.id_to_piece(i) for i in own))}


class Vocabulary:
    """Finds all pieces in words at once: hashes of pieces and of their beginnings, sorted, behind a table of bits."""

    SLOTS = 22

    def __init__(self, column: dict[str, int]):
        known = {p[:n]: -1 for p in column for n in range(1, len(p))}
        known.update(column)
        texts = list(known)
        sums, start, end = self.hashed(texts)
        h = stretch(sums, start, end)
        order = np.argsort(h)
        self.hash, self.piece = h[order], np.fromiter(known.values(), np.int64, len(known))[order]
        self.slots = np.zeros(1 << self.SLOTS, bool)
        self.slots[(self.hash >> np.uint64(64 - self.SLOTS)).astype(np.int64)] = True
        self.longest = max(map(len, column), default=1)
        self.size = len(column)

    @staticmethod
    def hashed(words: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        return prefix_sums(mix(codes + np.uint64(1)), BASES[0]), np.concatenate([[0], end[:-1]]), end

    def edges(self, words: list[str]) -> list[np.ndarray]:
        """[n-1][i]: the piece of n characters from character i of the words, strung together, on; -1 if none.
        A single character that is no piece is piece `size`, the unknown one."""
        sums, _, end = self.hashed(words)
        stop = np.repeat(end, np.diff(end, prepend=0))  # of each character's word
        at, out = np.arange(len(stop)), []
        for n in range(1, self.longest + 1):
            at = at[at + n <= stop[at]]
            found = np.full(len(stop), -1, np.int64)
            if len(at):
                h = stretch(sums, at, at + n)
                maybe = self.slots[(h >> np.uint64(64 - self.SLOTS)).astype(np.int64)]
                at, h = at[maybe], h[maybe]
                k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
                same = self.hash[k] == h
                at, k = at[same], k[same]
                found[at] = self.piece[k]
            if n == 1:
                found[found < 0] = self.size
            out.append(found)
        return out


def batches_of(words: list[str], most: int = 40_000) -> Iterator[list[int]]:
    """Numbers of words of like length, so many that their characters fit arrays of bounded size; a longer word is alone."""
    order, at = sorted(range(len(words)), key=lambda i: len(words[i])), 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(words[order[to]]) <= most:
            to += 1
        yield order[at:to]
        at = to


def log_sums(ends: np.ndarray, edges: list[np.ndarray], weight: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, every: bool = False) -> np.ndarray:
    """The log of the sum over all segmentations of words strung together, which end at `ends`, in order of their length;
    with `every`, up to each of a word's places (n + 1 of n characters), one word's after the other's.
    weight(words, pieces) gives an array of `width` probabilities for each."""
    length = np.diff(ends, prepend=0)
    begin = ends - length
    node = begin + np.arange(len(ends))
    sums = np.zeros((int(ends[-1]) + len(ends), width))
    raised, own = np.zeros_like(sums), np.zeros((len(ends), width))  # logs of what places, and the words' last ones, were multiplied by
    sums[node] = 1.0
    for e in range(1, int(length[-1]) + 1):
        alive = np.arange(np.searchsorted(length, e), len(ends))
        now = np.zeros((len(alive), width))
        for n in range(1, min(e, len(edges)) + 1):
            k = edges[n - 1][begin[alive] + e - n]
            some = np.flatnonzero(k >= 0)
            if len(some):
                now[some] += sums[node[alive[some]] + e - n] * weight(alive[some], k[some])
        sums[node[alive] + e] = now
        raised[node[alive] + e] = own[alive]
        if e % 8 == 0 and (now < 1e-100).any():
            up = np.where(now < 1e-100, 1e150, 1.0)
            for back in range(min(e, len(edges)) + 1):
                sums[node[alive] + e - back] *= up
                raised[node[alive] + e - back] += np.log(up)
            own[alive] += np.log(up)
    return np.log(sums) - raised if every else np.log(sums[node + length]) - raised[node + length]


def forward(words: list[str], vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """log P(word) under each language, summed over all segmentations. prob: languages x (pieces, UNKNOWN)."""
    out = np.zeros((len(words), len(prob)))
    by_piece = np.ascontiguousarray(prob.T)
    for mine in batches_of(words):
        some = [words[i] for i in mine]
        out[mine] = log_sums(np.cumsum([len(w) for w in some]), vocabulary.edges(some), lambda _, k: by_piece[k], len(prob))
    return out


def expected(words: list[str], langs: np.ndarray, times: np.ndarray, vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """How often each piece is expected in so many occurrences of words of these languages, over all their segmentations:
    the sum that leads to a piece's place, its probability and the sum of what follows, over the word's. (languages x pieces)"""
    into, flat = np.zeros(prob.size), prob.reshape(-1)
    for mine in batches_of(words):
        some = [words[i] for i in mine]
        base = langs[mine] * prob.shape[1]
        edges = vocabulary.edges(some)
        ends = np.cumsum([len(w) for w in some])
        length = np.diff(ends, prepend=0)
        word = np.repeat(np.arange(len(some)), length)
        place = np.arange(len(word)) - (ends - length)[word]
        turned = []  # the same pieces, with words read from their ends
        for n, k in enumerate(edges, 1):
            at = np.flatnonzero(place + n <= length[word])
            turned.append(np.full(len(k), -1, np.int64))
            turned[-1][(ends - length)[word[at]] + length[word[at]] - place[at] - n] = k[at]
        weight = lambda w, k, base=base: flat[base[w] + k][:, None]
        there, back = (log_sums(ends, x, weight, 1, every=True)[:, 0] for x in (edges, turned))
        node = ends - length + np.arange(len(some))
        for n, k in enumerate(edges, 1):
            at = np.flatnonzero(k >= 0)
            w = word[at]
            key = base[w] + k[at]
            share = np.exp(there[node[w] + place[at]] + np.log(flat[key]) + back[node[w] + length[w] - place[at] - n] - back[node[w] + length[w]])
            into += np.bincount(key, share * times[mine][w], len(into))
    return into.reshape(prob.shape)


def tokens_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Model:
    """Languages and, for each, log probabilities of pieces; bounded by languages x vocabulary."""

    def __init__(self, langs: list[str], prob: np.ndarray, model_file: str):
        self.langs, self.prob, self.model_file = langs, prob, model_file


def fit(labelled: DataFrame, model_file: str, per_language: int = 1000, rounds: int = 2) -> Model:
    """Fits piece probabilities to rows (text, lang), null langs and texts left out, by expectation maximisation.

    The sample of labelled rows is bounded: of each language, the rows whose hash lies below a threshold that keeps about
    `per_language` (all, if there are no more). The first probabilities come from the vocabulary's own merges.
    Piece counts are summed by Spark; the driver gets languages x pieces numbers.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    column = pieces_of(model_file)
    if not langs:
        return Model([], np.zeros((0, len(column) + 1)), model_file)
    share: Column = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                c.update((lang, w) for w in tokens_of(text))
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c]), pa.array([k[1] for k in c]), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    words = materialize(some.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    index = {lang: i for i, lang in enumerate(langs)}

    def step(prob: np.ndarray | None):
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pieces_of(model_file)
            got = np.zeros((len(langs), len(own) + 1))
            if prob is None:
                import sentencepiece

                model = sentencepiece.SentencePieceProcessor(model_file=model_file)
            else:
                vocabulary = Vocabulary(own)
            for b in batches:
                ws, ls, ns = (b.column(c).to_pylist() for c in ("word", "lang", "n"))
                if prob is None:
                    for pieces, lang, n in zip(model.encode(ws, out_type=str, num_threads=1), ls, ns, strict=True):
                        for p in pieces:
                            if (k := own.get(p)) is not None:
                                got[index[lang], k] += n
                else:
                    got += expected([MARK + w for w in ws], np.array([index[x] for x in ls], np.int64), np.array(ns, float), vocabulary, prob)
            got = got[:, :-1]
            at = np.argwhere(got > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(got[at[:, 0], at[:, 1]])], names=["l", "k", "n"])

        got = np.zeros((len(langs), len(column)))
        for r in words.mapInArrow(summed, "l int, k int, n double").groupBy("l", "k").agg(F.sum("n").alias("n")).toLocalIterator():
            got[r["l"], r["k"]] = r["n"]
        got = np.round(got, 6) + 0.05
        return np.hstack([got / got.sum(axis=1, keepdims=True), np.full((len(langs), 1), UNKNOWN)])

    prob = step(None)
    for _ in range(rounds):
        prob = step(prob)
    discard(words)
    return Model(langs, prob, model_file)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs (text among them) with lang_pred and score, which replace columns of these names.

    Each word is scored once in a Python worker and remembered; a text's score in a language is the sum of its words'.
    score: the best language's share, languages being equally likely before. A text that is null or has no letter gets
    `und` and 0, and so does every text if nothing was learned. Ties go to the language first by name.
    """
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.prob))
    model_file, names = model.model_file, [f.name for f in kept]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prob = shared.value
        mark = hashlib.sha256(prob.tobytes()).hexdigest()
        if mark not in _HELD:
            _HELD.clear()
            _HELD[mark] = ({}, [np.zeros((1 << 12, len(langs)))], Vocabulary(pieces_of(model_file)))
        memo, tables, vocabulary = _HELD[mark]
        most = min(MEMO, MEMO_CELLS // max(1, len(langs)))
        for b in batches:
            preds, scores = [], []
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 200):
                split = [tokens_of(t) for t in texts[at : at + 200]]
                new = [w for w in set(chain_of(split)) if w not in memo]
                if len(memo) + len(new) > most:
                    memo.clear()
                    new = list(set(chain_of(split)))
                if new and langs:
                    new.sort()
                    first = len(memo)
                    while first + len(new) > len(tables[0]):
                        tables[0] = np.vstack([tables[0], np.zeros_like(tables[0])])
                    tables[0][first : first + len(new)] = forward([MARK + w for w in new], vocabulary, prob)
                    memo.update(zip(new, range(first, first + len(new)), strict=True))
                for text, ws in zip(texts[at : at + 200], split, strict=True):
                    if not langs or not text or not LETTER.search(text):
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    total = tables[0][np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    best = int(np.argmax(total))
                    preds.append(langs[best])
                    scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(judged, schema)


def chain_of(lists: list[list[str]]) -> Iterator[str]:
    for x in lists:
        yield from x


def held_out() -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
