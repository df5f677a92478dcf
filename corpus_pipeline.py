"""From raw documents to packed training sequences: language, lines, near-duplicates, benchmark passages, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.llm import decontaminate, langid, linededup, neardup, packing
from lumenveil.llm.common import delete, discard, materialize, read_table, recorded, swept

#: A document goes if no language is this likely.
LEAST_SCORE = 0.5
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last stage's result is computed from, by application and input.
_LEFT: dict[tuple[str, str], set[str]] = {}


def tidy(stage: Stage) -> Stage:
    """Deletes the tables behind the stage before, once its own result is written and reread: docs reads none of them then."""

    @wraps(stage)
    def own(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        left = _LEFT.pop(key, set())
        if left and not any(path.split("://")[-1] in file for file in docs.inputFiles() for path in left):
            delete(spark, left)
            left = set()
        swept(spark)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _LEFT[key] = left | made
        return out

    return own


@tidy
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is recognised: null texts, texts without a letter, and undecided ones."""
    model = langid.fit(docs.where(~langid.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    judged = langid.predict(docs, model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


@tidy
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each group of like lines; documents left without a line go."""
    return linededup.without_surplus(docs)


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles link at 0.8."""
    return neardup.without_copies(docs, neardup.Join(width=5))


@tidy
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.Decontaminator(docs, read_table(spark, sf_dir, "benchmark")).clean(docs)


@tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), **packing.PRODUCTION)


STAGES = [
    ("language", keep_known_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL can't express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written to the shared folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, last = materialize(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        discard(last)
    return docs
