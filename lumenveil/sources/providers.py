"""Models stand behind tables: recognised spans, predictions, log probabilities and responses.

A provider is a function from a DataFrame of texts to one of answers. table() reads answers that a model gave before; live()
runs a Python function of a batch on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands in for a response that could not be had.
APOLOGY = "Sorry, I cannot answer this question at the moment."


def table(answers: DataFrame, on: str = "doc_id") -> Callable[[DataFrame], DataFrame]:
    return lambda texts: texts.join(answers, on, "left")


def live(answer: Callable[[list[str]], list[str]], column: str = "response", partitions: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Adds the answers to `text`; a batch that fails gets APOLOGY."""

    def asked(texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                try:
                    got = answer(b["text"].fillna("").tolist())
                except Exception:  # noqa: BLE001  a remote model may fail in any way
                    got = [APOLOGY] * len(b)
                yield b.assign(**{column: got})

        dealt = texts.repartition(partitions) if partitions else texts
        return dealt.mapInPandas(run, texts.withColumn(column, F.lit("")).schema)

    return asked
