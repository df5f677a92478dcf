"""How much of the original a perturbed text gives away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import bind
from ..functions.tokens import ngrams, words
from .knn import dot


def ngram_leakage(original: Column, perturbed: Column, n: int = 3) -> Column:
    """Share of the original's distinct runs of n words that the perturbed text has too; 0 for none."""
    def share(a: Column) -> Column:
        return F.when(F.size(a) > 0, F.size(F.array_intersect(a, ngrams(words(perturbed), n))) / F.size(a)).otherwise(0.0)

    return bind(ngrams(words(original), n), share)


def entity_words(entities: Column) -> Column:
    """Distinct lower-case words of entities."""
    return F.array_distinct(F.flatten(F.transform(entities, lambda e: words(F.lower(e["text"])))))


def set_scores(original: Column, perturbed: Column) -> dict[str, Column]:
    """Precision, recall and F1 of the words that two sets share."""
    common = F.size(F.array_intersect(original, perturbed))
    p = F.when(F.size(perturbed) > 0, common / F.size(perturbed)).otherwise(0.0)
    r = F.when(F.size(original) > 0, common / F.size(original)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def similarity(a: Column, b: Column) -> Column:
    return dot(a, b)


def census(docs: DataFrame) -> DataFrame:
    """(total, per_doc) of distinct words in the entities of each document."""
    n = F.size(F.array_distinct(F.flatten(F.transform("entities", lambda e: words(e["text"])))))
    return docs.select(n.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.avg("n").alias("per_doc"))


def census_by_user(comments: DataFrame) -> DataFrame:
    """(users, comments, total, per_user, per_comment) of distinct entity words of each user, for rows (user, entities)."""
    each = comments.select("user", F.explode_outer(F.array_distinct(F.flatten(F.transform("entities", lambda e: words(e["text"]))))).alias("w"))
    n = each.groupBy("user").agg(F.count_distinct("w").alias("n")).agg(F.count("*").alias("users"), F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(comments.agg(F.count("*").alias("comments")))).select("users", "comments", "total", (F.col("total") / F.col("users")).alias("per_user"), (F.col("total") / F.col("comments")).alias("per_comment"))


def report(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Means and sums of measures, for each group."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("avg", F.avg), ("sum", F.sum))])
