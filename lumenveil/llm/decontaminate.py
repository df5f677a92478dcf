"""Benchmark decontamination by latent semantic retrieval, subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marks, small_batches, word_hashes

#: Words here are lower-cased stretches without white space and common punctuation.
PARTS = marks(b" \t\n\x0b\x0c\r.,;:!?\"'()")
FOLD = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)
#: Words of a text whose windows are held at once.
SPAN = 1 << 14
#: Candidates whose words are counted at once.
COUNTED = 1 << 12
TABLE = bytes(32 if PARTS[b] else int(FOLD[b]) for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TABLE).split() if text else []


@dataclass(frozen=True)
class Retrieval:
    """buckets: hashed vocabulary. rank: latent dimensions; extra: more of them in the sketch. passage: words of a passage that
    the decomposition sees. windows: lengths of windows searched, each moved by a quarter; items below the least length have their own.
    short: items of fewer words are searched verbatim.
    verbatim: share of an item's words, in order, that condemns by itself; paraphrase: the share that does if the answer's
    words are there as well, in order, to the share `answer`. The answer is the item's last fifth, 3 words at least.
    gate: least cosine of a window with a part of an item that makes it a candidate. block: benchmark items searched in one pass. common: a word that a larger share of documents has is common."""

    buckets: int = 1 << 15
    rank: int = 32
    extra: int = 8
    passage: int = 64
    windows: tuple[int, ...] = (20, 36, 56)
    short: int = 5
    verbatim: float = 0.85
    paraphrase: float = 0.7
    answer: float = 0.6
    gate: float = 0.5
    block: int = 2000
    common: float = 0.1


def hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of each text's words, in order; their low bits are buckets."""
    for (h,) in word_hashes(texts, FOLD, PARTS):
        yield h


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h & np.uint64(buckets - 1)).astype(np.int64)


class Lexicon:
    """The words of some benchmark items, by hash; finds them among a text's words."""

    SLOTS = 22

    def __init__(self, words: np.ndarray):
        self.words = np.unique(words)
        self.slots = np.zeros(1 << self.SLOTS, bool)
        self.slots[(self.words >> np.uint64(64 - self.SLOTS)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in h words of the lexicon stand, and their numbers."""
        at = np.flatnonzero(self.slots[(h >> np.uint64(64 - self.SLOTS)).astype(np.int64)])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        same = self.words[k] == h[at]
        return at[same], k[same]


def frequencies(docs: DataFrame, words: list[np.ndarray], config: Retrieval) -> tuple[np.ndarray, list[np.ndarray], int]:
    """In how many documents each bucket is; in how many each of the given sorted word hashes is, list by list; all documents.
    Bounded tables that Spark sums; the driver gets no more than their sizes."""
    own = docs.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, np.uint64), *words])))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(own.value)
        df, n = np.zeros(config.buckets + len(lexicon.words), np.int64), 0
        for b in batches:
            for h in hashes(b.column("text")):
                if len(h):
                    here = np.sort(bucket(h, config.buckets))
                    df[here[np.flatnonzero(np.diff(here, prepend=-1))]] += 1
                    df[config.buckets + np.unique(lexicon.places(h)[1])] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["k", "n"])

    df, n = np.zeros(config.buckets + len(own.value)), 0
    for r in docs.select("text").mapInArrow(counted, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["k"] < 0:
            n = r["n"]
        else:
            df[r["k"]] = r["n"]
    return df[: config.buckets], [df[config.buckets + np.searchsorted(own.value, w)] for w in words], n


def decompose(docs: DataFrame, idf: np.ndarray, config: Retrieval) -> np.ndarray:
    """A map from buckets to `rank` latent dimensions, each divided by its singular value's root share (whitened).

    Randomised SVD of the matrix A of TF-IDF passages, rows of unit length, in one pass: each task adds up its part of
    A'(A W) for a fixed random W; Spark sums the parts by bucket. The driver gets buckets x (rank + extra) numbers and finds
    the leading right singular vectors from them (Nystroem's approximation of A'A).
    """
    width = config.rank + config.extra
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def random_w() -> np.ndarray:
        return np.random.default_rng(7).standard_normal((config.buckets, width)).astype(np.float32)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, w = shared.value, random_w()
        w *= weight[:, None]
        out = np.zeros((config.buckets, width))

        def add(ids: np.ndarray, starts: np.ndarray) -> None:
            length = np.diff(np.append(starts, len(ids)))
            norm = np.sqrt(np.add.reduceat(weight[ids] ** 2, starts)) + 1e-9
            z = np.add.reduceat(w[ids], starts, axis=0) / (norm**2)[:, None]
            order = np.argsort(ids.astype(np.min_scalar_type(config.buckets - 1)), kind="stable")  # of 16 bits, in linear time
            first = np.flatnonzero(np.diff(ids[order], prepend=-1))
            row = np.repeat(np.arange(len(starts)), length)[order]
            out[ids[order][first]] += np.add.reduceat(z[row], first, axis=0)

        held: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        n = 0
        for b in batches:
            for whole in (bucket(h, config.buckets) for h in hashes(b.column("text"))):
                for at in range(0, len(whole), 1 << 16):
                    ids = whole[at : at + (1 << 16)]
                    held.append(ids)
                    marks.append(n + np.arange(0, len(ids), config.passage))
                    n += len(ids)
                    if n > 1 << 16:
                        add(np.concatenate(held), np.concatenate(marks))
                        held, marks, n = [], [], 0
        if n:
            add(np.concatenate(held), np.concatenate(marks))
        out *= weight[:, None]
        at = np.flatnonzero(out.any(axis=1))
        flat = pa.array(out[at].reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), flat)], names=["k", "v"])

    parts = docs.select("text").mapInArrow(sketched, "k int, v array<double>")
    y = np.zeros((config.buckets, width))
    for r in parts.groupBy("k").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)]).toLocalIterator():
        y[r["k"]] = list(r)[1:]
    w = random_w().astype(np.float64)
    shift = 1e-7 * np.linalg.norm(y)
    core = w.T @ (y + shift * w)
    value, vector = np.linalg.eigh((core + core.T) / 2)
    value = np.maximum(value, max(value[-1], 1e-12) * 1e-9)
    u, s, _ = np.linalg.svd((y + shift * w) @ (vector / np.sqrt(value)), full_matrices=False)
    latent = u[:, : config.rank] / np.maximum(s[: config.rank], max(s[0], 1e-12) * 1e-6)
    return (latent * idf[:, None] * (s[0] or 1.0)).astype(np.float32)


def subsequence(item: list[bytes], region: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in region:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Index:
    """Benchmark items of one block as latent chunks, by the length of window that suits them.

    An item that a text leaks shares `paraphrase` of its words with it, and only so many of them can be common ones; so `need`
    of its other words stand in the text, close together. Items are searched where theirs do; those that may be made up
    of common words, everywhere. This leaves out nothing that the checks would keep.
    """

    def __init__(self, items: list[tuple[int, str]], rare: np.ndarray, latent: np.ndarray, config: Retrieval):
        self.config, self.latent = config, latent
        self.ids = [i for i, _ in items]
        self.words = [terms(t) for _, t in items]
        self.rare = Lexicon(rare)
        self.hashes: list[np.ndarray] = []
        self.chunks: list[list[tuple[int, int, np.ndarray]]] = []  # of each item: length of window, first word, unit vector
        parted: dict[int, list[tuple[int, int, np.ndarray]]] = {}  # of each length of window: item, first word, unit vector
        need, pairs = [], []
        for k, h in enumerate(hashes(pa.array([t for _, t in items], pa.string()))):
            own = self.rare.places(h)[1]
            self.hashes.append(h)
            need.append(self.least(k) - (len(h) - len(own)))
            if need[-1] > 0:
                pairs += [(w, k) for w in set(own.tolist())]
            parts, mine = max(1, -(-len(h) // (config.windows[-1] + 8))), []
            for p in range(parts):
                a, z = len(h) * p // parts, len(h) * (p + 1) // parts
                v = latent[bucket(h[a:z], config.buckets)].sum(axis=0)
                if (norm := float(np.linalg.norm(v))) > 0:
                    mine.append((min(config.windows, key=lambda n: abs(n - (z - a))), a, v / norm))
                    if len(h) >= config.short:
                        n = min(config.windows, key=lambda n: abs(n - (z - a))) if z - a >= config.windows[0] else -(-(z - a) // 4) * 4
                        parted.setdefault(n, []).append((k, a, v / norm))
            self.chunks.append(mine)
        self.own = [np.unique(h) for h in self.hashes]
        self.parts = {n: (np.array([k for k, _, _ in x]), np.array([a for _, a, _ in x]), np.stack([v for _, _, v in x], axis=1)) for n, x in sorted(parted.items())}
        self.all = Lexicon(np.concatenate([np.zeros(1, np.uint64), *self.own]))
        bits = np.zeros((len(self.all.words) + 1, -(-len(items) // 8)), np.uint8)  # of each word: the items that have it
        for k, own in enumerate(self.own):
            bits[np.searchsorted(self.all.words, own), k >> 3] |= 1 << (k & 7)
        self.bits = bits
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.reach = int(max(self.size, default=0)) + 2 * config.windows[-1]
        self.repeated = np.array([n - len(own) for n, own in zip(self.size.tolist(), self.own, strict=True)], np.int64)
        self.enough = np.array([self.least(k) for k in range(len(items))], np.int64)
        self.need = np.array(need, np.int64)
        self.span = np.array([len(w) + 2 * config.windows[-1] for w in self.words], np.int64)
        self.open = [k for k, n in enumerate(need) if n <= 0]
        pairs.sort()
        self.item = np.array([k for _, k in pairs], np.int64)
        self.first = np.searchsorted(np.array([w for w, _ in pairs], np.int64), np.arange(len(self.rare.words) + 1))

    def least(self, k: int) -> int:
        """How many of an item's words a text that leaks it has at least: all of a short item."""
        m = len(self.words[k])
        return m if m < self.config.short else int(np.ceil(self.config.paraphrase * m - 1e-9))

    def spots(self, h: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Stretches of words, by item, in which enough of its rare words stand close together; all for items without."""
        out: dict[int, list[tuple[int, int]]] = {k: [(0, len(h))] for k in self.open}
        at, word = self.rare.places(h)
        if not len(at):
            return out
        count = self.first[word + 1] - self.first[word]
        item = self.item[np.repeat(self.first[word] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        at = np.repeat(at, count)
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        last = np.arange(len(item)) + self.need[item] - 1
        inside = np.minimum(last, len(item) - 1)
        good = np.flatnonzero((last < len(item)) & (item[inside] == item) & (at[inside] - at <= self.span[item]))
        for k, lo, hi in zip(item[good].tolist(), at[good].tolist(), at[inside[good]].tolist(), strict=True):
            mine = out.setdefault(k, [])
            reach = len(self.words[k]) + self.config.windows[-1]
            if mine and lo - reach <= mine[-1][1]:
                mine[-1] = (mine[-1][0], min(len(h), hi + reach))
            else:
                mine.append((max(0, lo - reach), min(len(h), hi + reach)))
        return out

    def search(self, text: Callable[[], str | None], h: np.ndarray) -> list[tuple[int, float, float, int, str]]:
        """(item_id, cosine, share of its words in order, first word of the window, way) for each item that the text leaks; way is
        `latent` for those that the cosine search finds, `words` for others that counting words finds."""
        held: list[list[bytes]] = []

        def lowered() -> list[bytes]:
            if not held:
                held.append(terms(text()))
            return held[0]

        found = self.by_latent(lowered, h)
        return [(*found[k], "latent") for k in sorted(found)] + [(*x, "words") for x in self.by_words(lowered, h, found)]

    def leaked(self, text: Callable[[], str | None], h: np.ndarray) -> bool:
        """Whether search() would find anything."""
        lowered = lru_cache(1)(lambda: terms(text()))
        return bool(self.by_latent(lowered, h)) or next(self.by_words(lowered, h, {}), None) is not None

    def by_latent(self, lowered: Callable[[], list[bytes]], h: np.ndarray) -> dict[int, tuple[int, float, float, int]]:
        """What the cosine search finds, by item: of each window of each length, moved by a quarter, the parts of items at a cosine of
        `gate` or more; of these the windows whose surroundings hold enough of the item's words are checked, the nearest first."""
        found: dict[int, tuple[int, float, float, int]] = {}
        for lo in range(0, len(h), SPAN):
            # Stretches overlap by the longest surroundings, so that those of every leak lie in one of them.
            part = h[lo : lo + SPAN + self.reach]
            item, first, length, near = self.nearest(part)
            if not len(item):
                continue
            good = self.holding(part, item, first, length)
            for i in good[np.argsort(-near[good], kind="stable")].tolist():
                k = int(item[i])
                if k not in found and (x := self.judged(k, lowered(), max(0, lo + int(first[i])), int(length[i]), float(near[i]))):
                    found[k] = x
        return found

    def nearest(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, where its first word would stand, length of window, cosine) of all windows and parts of items within the gate."""
        out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        of = self.latent[bucket(h, self.config.buckets)]
        for n, (item, start, vectors) in self.parts.items():
            step = n // 4
            padded = np.zeros((-(-len(h) // step) + 3, step, of.shape[1]), np.float32)
            padded.reshape(-1, of.shape[1])[: len(h)] = of
            quarter = padded.sum(axis=1)
            v = quarter[:-3] + quarter[1:-2] + quarter[2:-1] + quarter[3:]
            v /= np.sqrt(np.einsum("ij,ij->i", v, v))[:, None] + 1e-9
            cosine = v @ vectors
            i, c = np.divmod(np.flatnonzero(cosine >= self.config.gate), cosine.shape[1])
            out.append((item[c], i * step - start[c], np.full(len(i), n), cosine[i, c].astype(np.float64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def holding(self, h: np.ndarray, item: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which candidates have surroundings, those that judged() looks at, that hold as many of the item's words as any leak has. Only
        the words of items are looked at: counted in steps of four first, which counts too many at most, then one by one, where a
        word that stands there twice counts once and all that an item repeats is taken to be there."""
        at, word = self.all.places(h)
        has = np.zeros((-(-len(at) // 4) * 4 + 4, self.bits.shape[1] * 8), np.uint8)
        has[: len(at)] = np.unpackbits(self.bits[word], axis=1, bitorder="little")
        four = has.reshape(-1, 4, has.shape[1])
        count = np.zeros((len(four) + 1, has.shape[1]), np.int32)
        np.cumsum(four[:, 0] + four[:, 1] + four[:, 2] + four[:, 3], axis=0, out=count[1:])
        first = np.maximum(0, first)
        upto = np.zeros(len(h) + 1, np.int64)
        upto[at + 1] = 1
        np.cumsum(upto, out=upto)
        begin = upto[np.minimum(len(h), np.maximum(0, first - length // 2))]
        end = upto[np.minimum(len(h), first + self.size[item] + length)]
        some = np.flatnonzero((count[-(-end // 4), item] - count[begin // 4, item] >= self.enough[item]) & (begin < end))
        before = np.full(len(at), -1)  # where each word stood last
        order = np.argsort(word, kind="stable")
        again = np.flatnonzero(word[order[1:]] == word[order[:-1]])
        before[order[again + 1]] = order[again]
        good = [np.zeros(0, np.int64)]
        for lo in range(0, len(some), COUNTED):
            part = some[lo : lo + COUNTED]
            size = end[part] - begin[part]
            own = np.cumsum(size) - size
            place = np.arange(int(size.sum())) + np.repeat(begin[part] - own, size)
            new = has[place, np.repeat(item[part], size)].view(bool) & (before[place] < np.repeat(begin[part], size))
            distinct = np.add.reduceat(new, own, dtype=np.int64)
            good.append(part[distinct + self.repeated[item[part]] >= self.enough[item[part]]])
        return np.concatenate(good)

    def by_words(self, lowered: Callable[[], list[bytes]], h: np.ndarray, known: dict) -> Iterator[tuple[int, float, float, int]]:
        """What counting words finds of the items that are not known: whatever passes the checks, at any cosine."""
        spots = self.spots(h) if len(h) else {}
        for k in sorted(spots.keys() - known.keys()):
            for lo, hi in spots[k]:
                n, first = self.candidates(k, h, lo, hi)
                if not len(first):
                    continue
                near = self.cosines(k, h, first)
                order = np.argsort(-near, kind="stable")
                best = next((x for i in order.tolist() if (x := self.judged(k, lowered(), int(first[i]), n, float(near[i])))), None)
                if best:
                    yield best
                    break

    def candidates(self, k: int, h: np.ndarray, lo: int, hi: int) -> tuple[int, np.ndarray]:
        """The length of an item's windows, and the first words of those in lo..hi whose surroundings, which judged() looks at,
        hold as many of the item's words as a leak needs."""
        m = len(self.words[k])
        if m < self.config.short:
            at = np.arange(lo, hi - m + 1)
            for i, w in enumerate(self.hashes[k]):
                at = at[h[at + i] == w]
            return 0, at
        n = min(m, self.config.windows[0]) if m < self.config.windows[0] else min(self.config.windows, key=lambda n: abs(n - m))
        first = np.arange(lo, hi, max(1, n // 4))
        start = max(0, lo - n // 2)
        near = h[start : hi + m + n]
        at = np.minimum(np.searchsorted(self.own[k], near), len(self.own[k]) - 1)
        count = np.concatenate([[0], np.cumsum(self.own[k][at] == near)])
        inside = count[np.minimum(first + m + n - start, len(near))] - count[np.maximum(0, first - n // 2 - start)]
        return n, first[inside >= self.least(k)]

    def cosines(self, k: int, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The greatest cosine of an item's chunks with the windows that match them; candidates are judged in its order."""
        out = np.zeros(len(first))
        lo, reach = int(first[0]), len(self.words[k]) + self.config.windows[-1]
        ids = bucket(h[lo : int(first[-1]) + reach], self.config.buckets)
        sums = np.zeros((len(ids) + 1, self.latent.shape[1]))
        np.cumsum(self.latent[ids], axis=0, out=sums[1:])
        for n, start, vector in self.chunks[k]:
            at = first - lo + start
            v = sums[np.minimum(at + n, len(ids))] - sums[np.minimum(at, len(ids))]
            out = np.maximum(out, v @ vector / (np.sqrt(np.einsum("ij,ij->i", v, v)) + 1e-9))
        return out

    def judged(self, k: int, lowered: list[bytes], first: int, n: int, near: float) -> tuple[int, float, float, int] | None:
        if len(self.words[k]) < self.config.short:
            return (self.ids[k], near, 1.0, first) if lowered[first : first + len(self.words[k])] == self.words[k] else None
        region = lowered[max(0, first - n // 2) : max(0, first + len(self.words[k]) + n)]
        share = subsequence(self.words[k], region) / len(self.words[k])
        tail = self.words[k][-max(3, len(self.words[k]) // 5) :]
        if share >= self.config.verbatim or (share >= self.config.paraphrase and subsequence(tail, region) >= self.config.answer * len(tail)):
            return self.ids[k], near, share, first
        return None


class Decontaminator:
    """Learned from all rows of docs (text) once; finds or drops rows that leak items of benchmark (item_id, text).

    Items are searched in blocks of `block`, each in a pass over all documents: what a task holds does not grow with the benchmark.
    Null and empty texts leak nothing; null or empty items are not looked for, and items of fewer than 5 words verbatim. Repeated
    rows and items are each found. Empty tables give no rows. Texts are searched whole, in stretches of 2**14 words. leaks() reads
    doc_id and text alone, clean() keeps all columns.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, config: Retrieval = Retrieval()):
        self.config, self.spark = config, docs.sparkSession
        small_batches(self.spark)
        self.blocks: list[list[tuple[int, str]]] = []
        some: list[tuple[int, str]] = []
        for r in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
            if terms(r["text"]):
                some.append((r["item_id"], r["text"]))
                if len(some) == config.block:
                    self.blocks.append(some)
                    some = []
        if some or not self.blocks:
            self.blocks.append(some)
        words = [np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes(pa.array([t for _, t in b], pa.string()))])) for b in self.blocks]
        df, own, n = frequencies(docs, words, config)
        self.rare = [w[d <= max(1, config.common * n)] for w, d in zip(words, own, strict=True)]
        self.latent = decompose(docs, (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32), config)

    def _shared(self):
        latent = self.spark.sparkContext.broadcast(self.latent)
        return [(latent, self.spark.sparkContext.broadcast(b)) for b in zip(self.blocks, self.rare, strict=True)]

    def leaks(self, docs: DataFrame) -> DataFrame:
        """(doc_id, item_id, cosine, in_order, first_word, way): a row for each row of docs (doc_id, text) and item that it leaks."""
        config, out = self.config, None
        for latent, block in self._shared():

            def found(batches: Iterator[pa.RecordBatch], latent=latent, block=block) -> Iterator[pa.RecordBatch]:
                index = Index(*block.value, latent.value, config)
                for b in batches:
                    rows = [(doc, *x) for doc, text, h in zip(b.column("doc_id").to_pylist(), b.column("text"), hashes(b.column("text")), strict=True) for x in index.search(text.as_py, h)]
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "item_id", "cosine", "in_order", "first_word", "way"])

            part = docs.select("doc_id", "text").mapInArrow(found, "doc_id long, item_id long, cosine double, in_order double, first_word long, way string")
            out = part if out is None else out.union(part)
        return out

    def clean(self, docs: DataFrame) -> DataFrame:
        """Rows of docs, all columns, that leak no item."""
        config = self.config
        for latent, block in self._shared():

            def kept(batches: Iterator[pa.RecordBatch], latent=latent, block=block) -> Iterator[pa.RecordBatch]:
                index = Index(*block.value, latent.value, config)
                for b in batches:
                    yield b.filter(pa.array([not index.leaked(t.as_py, h) for t, h in zip(b.column("text"), hashes(b.column("text")), strict=True)], pa.bool_()))

            docs = docs.mapInArrow(kept, docs.schema)
        return docs
