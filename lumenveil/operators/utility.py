"""What use is left in perturbed texts and answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from ..functions import scores
from ..functions.spans import bind
from ..functions.tokens import words

#: A label that could not be read.
UNREAD = 100
LABEL = r"""\{\s*["']label["']\s*:\s*(\d+)\s*\}"""


def label_of(response: Column) -> Column:
    """The first label in a response; 100 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(response, F.lit("")), LABEL, 1), F.lit("")).try_cast("int"), F.lit(UNREAD))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length, without case; empty texts score 0."""
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - F.levenshtein(a, b) / longer).otherwise(0.0)


def ngram_f(reference: Column, candidate: Column, n: int) -> Column:
    """F score of two texts' runs of n words with their counts."""
    runs = lambda t: bind(words(F.lower(t)), lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.array_join(F.slice(w, i + 1, n), " ")))

    def common(a: Column, b: Column) -> Column:
        # Runs sorted with their number among equals: two lists share as many as there are equal (run, number).
        numbered = lambda x: bind(F.array_sort(x), lambda s: F.transform(s, lambda v, i: F.struct(v.alias("v"), (i - F.array_position(s, v)).alias("k"))))
        return F.size(F.array_intersect(numbered(a), numbered(b)))

    a, b = runs(reference), runs(candidate)
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * common(a, b) / total).otherwise(0.0)


def text_scores(pairs: DataFrame) -> DataFrame:
    """Adds bleu, rouge1, rouge2, rougeL and ter to rows (reference, candidate); exact sequence measures need programs, so Arrow
    batches are scored by plain functions (functions/scores.py). Nulls count as empty."""
    schema = T.StructType([*pairs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("bleu", "rouge1", "rouge2", "rougeL", "ter")]])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [scores.all_scores(r or "", c or "") for r, c in zip(b["reference"], b["candidate"], strict=True)]
            yield b.assign(**{k: [x[k] for x in rows] for k in ("bleu", "rouge1", "rouge2", "rougeL", "ter")})

    return pairs.mapInPandas(score, schema)


@F.pandas_udf(T.StringType())
def summary_of(responses: pd.Series) -> pd.Series:
    """The summary in each response, by the first way that works; else empty."""
    return responses.map(lambda x: scores.summary(x or ""))


def confusion(rows: DataFrame, exclude_unread: bool = True) -> DataFrame:
    """(truth, pred, n)."""
    kept = rows.where(F.col("pred") != UNREAD) if exclude_unread else rows
    return kept.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def classification(rows: DataFrame, exclude_unread: bool = True) -> DataFrame:
    """One row (accuracy, weighted_f1, macro_f1, valid, total) for rows (truth, pred); 0 if nothing is valid.

    Counts for each class come from one confusion table; its size is that of the classes squared."""
    table = confusion(rows, exclude_unread)
    each = table.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given")))).alias("x")).select("x.*")
    per = each.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("given").alias("given"))
    per = per.withColumn("f1", F.when(F.col("support") + F.col("given") > 0, 2.0 * F.col("tp") / (F.col("support") + F.col("given"))).otherwise(0.0))
    total = rows.agg(F.count("*").alias("total"))
    out = per.agg(F.coalesce(F.sum("tp") / F.sum("support"), F.lit(0.0)).alias("accuracy"), F.coalesce(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), F.lit(0.0)).alias("weighted_f1"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.coalesce(F.sum("support"), F.lit(0)).alias("valid"))
    return out.crossJoin(F.broadcast(total))


def perplexity_report(rows: DataFrame) -> DataFrame:
    """(perplexity, valid): mean over finite values of `perplexity`."""
    finite = F.when(F.col("perplexity") != float("inf"), F.col("perplexity"))
    return rows.agg(F.avg(finite).alias("perplexity"), F.count(finite).alias("valid"))


def perplexity(logprobs: DataFrame, prefix: int = 0) -> DataFrame:
    """(doc_id, perplexity) from a provider's log probabilities (doc_id, pos, logprob); the first `prefix` places are context.
    Infinite if nothing is left."""
    own = logprobs.groupBy("doc_id").agg(F.avg(F.when(F.col("pos") >= prefix, F.col("logprob"))).alias("m"))
    return own.select("doc_id", F.coalesce(F.exp(-F.col("m")), F.lit(float("inf"))).alias("perplexity"))
