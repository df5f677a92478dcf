"""Quality rules: base statistics and a learned decision list, both as Spark expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, materialize

#: What the learned rules may look at; each is a number from 0 on, and 0 for a text without words.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share", "digit_share")


def bind(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable holds it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that a text has twice or more, the first included.

    Windows are hashed, sorted with their places and compared with their neighbours, so a long text costs n log n.
    """
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
        places = F.array_sort(F.transform(twice, lambda e: e["i"]))
        return bind(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return bind(F.array_sort(windows), covered).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds base statistics to rows with `text`. Null texts have no words and zeros throughout."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")
    of_words = bind(
        F.filter(F.split(text, SPACE), lambda x: x != ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
    )
    lines = bind(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = docs.withColumns({"_w": of_words, "n_symbols": count("#*$%&|<>"), "n_dup_lines": lines, "n_upper": count(r"\p{Lu}"), "n_exclaim": count("!"), "n_digits": count("0-9")})
    return out.withColumns({"n_words": F.col("_w.n_words"), "word_chars": F.col("_w.word_chars"), "n_repeat_words": F.col("_w.n_repeat_words")}).drop("_w")


def features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"), "mean_word": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / chars, "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words, "upper_share": F.col("n_upper") / chars, "exclaim_share": F.col("n_exclaim") / chars, "digit_share": F.col("n_digits") / chars,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Literal, ...]


def learn(rows: list[tuple], precision: float = 0.95, cuts: int = 48, longest: int = 4, most: int = 12) -> list[Rule]:
    """Sequential covering over rows (bad, split, *FEATURES): conjunctions that pick bad rows, in the order of their finding.

    Each rule grows by the condition of largest information gain on the growing rows (split false) and loses final conditions
    as long as that does not lower its worth on the pruning rows. A rule stays if at least `precision` of all rows that it
    picks are bad; rows that it picks are set aside. Sets of rows are bits of integers.
    """
    full = (1 << len(rows)) - 1
    bits = lambda flags: sum(1 << i for i, x in enumerate(flags) if x)
    bad, prune = bits([r[0] for r in rows]), bits([r[1] for r in rows])
    grow = full & ~prune
    literals: dict[Literal, int] = {}
    for k, name in enumerate(FEATURES):
        values = sorted(r[2 + k] for r in rows)
        steps = sorted({values[len(values) * q // cuts] for q in range(1, cuts)} | {(a + b) / 2 for q in range(1, cuts) for a, b in [(values[len(values) * q // cuts - 1], values[min(len(values) * q // cuts, len(values) - 1)])]}) if values else []
        for t in steps:
            over = bits([r[2 + k] > t for r in rows])
            literals[Literal(name, True, float(t))] = over
            literals[Literal(name, False, float(t))] = full & ~over
    rules: list[Rule] = []
    left = full
    while len(rules) < most and (left & bad & grow):
        rule: list[Literal] = []
        masks: list[int] = []
        now = left & grow
        while len(rule) < longest and now & ~bad:
            p, n = (now & bad).bit_count(), (now & ~bad).bit_count()
            base, best, gain = math.log2(p / (p + n)), None, 0.0
            for lit, mask in literals.items():
                q = (now & mask & bad).bit_count()
                if q and (g := q * (math.log2(q / (now & mask).bit_count()) - base)) > gain + 1e-9:
                    best, gain = lit, g
            if best is None:
                break
            rule.append(best)
            masks.append(literals[best])
            now &= literals[best]
        if not rule:
            break

        def picked(k: int, among: int) -> int:
            for m in masks[:k]:
                among &= m
            return among

        def worth(k: int) -> float:
            got = picked(k, left & prune)
            return ((got & bad).bit_count() - (got & ~bad).bit_count()) / got.bit_count() if got else -1.0

        keep = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        got = picked(keep, left)
        if (got & bad).bit_count() < precision * got.bit_count() or (got & bad).bit_count() < 2:
            keep = len(rule)
            got = picked(keep, left)
            if (got & bad).bit_count() < precision * got.bit_count() or (got & bad).bit_count() < 2:
                break
        rules.append(tuple(rule[:keep]))
        left &= ~got
    return rules


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> list[Rule]:
    """Learns rules from documents (doc_id, text) with labels (doc_id, quality); quality 0 is bad.

    The sample is bounded: the `most` labelled ids that hash lowest, one row of documents for each. Nulls and ids
    with both labels are left out; so are documents that fail the base rules. Without rows or bad rows there are no rules.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    some = known.select("doc_id", F.col("lo").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # Written before statistics are taken: they cost as much as all the rest, and a filter on them would run ahead of the join.
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "quality-sample")
    rows = with_statistics(sample).where(~base_failed())
    named = [x.alias(k) for k, x in features().items()]
    got = rows.select((F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("split"), "doc_id", *named).orderBy(F.xxhash64("doc_id"), *FEATURES).limit(most).collect()
    discard(sample)
    return learn([(r["bad"], r["split"], *(r[f] for f in FEATURES)) for r in got])


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the first rule whose conditions all hold drops a row; a row that meets none is kept."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for lit in rule[1:]:
            holds = holds & lit.column()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each row of docs."""
    stats = with_statistics(docs.select("doc_id", "text"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
