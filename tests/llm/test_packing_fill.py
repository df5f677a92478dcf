"""How full sequences are, by the length of texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenveil.llm import packing
from tests.llm.edge import clashing


@pytest.mark.parametrize("words", [5, 20, 60, 100])
def test_short_texts_fill_sequences(spark, words):
    docs = clashing(spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("a "), words - 2 + (F.col("id") % 3).cast("int"))).alias("text")))
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), **packing.PRODUCTION)
    used, sequences, most = out.agg(F.sum("length"), F.count_distinct("sequence_id"), F.max(F.col("offset") + F.col("length"))).first()
    assert most <= 2048 and used / (2048 * sequences) >= (0.93 if words == 5 else 0.98)
