"""Datasets as DataFrames, with fixed schemas."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

ROW = "text string, label string"


def tsv(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """(text, label) of a file `label<TAB>text` with a header; quotes are plain characters unless quoted."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", '"' if quoted else "").schema("label int, text string").csv(path)
    return rows.select(F.btrim("text").alias("text"), F.col("label").cast("string").alias("label"))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) of dialogues with summaries, in one JSON array."""
    return spark.read.option("multiLine", True).schema("id string, dialogue string, summary string").json(path).select(F.col("dialogue").alias("text"), F.col("summary").alias("label"))


def users(spark: SparkSession, path: str) -> DataFrame:
    """(username, comments) of a file with a user in each line; lines that are no JSON are left out."""
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema("username string, comments array<struct<text:string>>, _bad string").json(path)
    return rows.where("_bad is null").drop("_bad")


def comments(users_: DataFrame) -> DataFrame:
    """(username, comment_idx, text): a row for each comment with a text."""
    return users_.select("username", F.posexplode("comments").alias("comment_idx", "c")).select("username", "comment_idx", F.col("c.text").alias("text")).where("text is not null")


def renested(comments_: DataFrame, by: str = "username", order: str = "comment_idx") -> DataFrame:
    """(username, comments): comments back in order under their user."""
    listed = comments_.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("c"))
    return listed.select(by, F.transform("c", lambda x: F.struct(x["text"].alias("text"))).alias("comments"))


def rewritten(users_: DataFrame, rewrite) -> DataFrame:
    """Users with each comment's text rewritten in place by a function of a column; other fields stay."""
    return users_.withColumn("comments", F.transform("comments", lambda c: F.when(c["text"].isNotNull(), c.withField("text", rewrite(c["text"]))).otherwise(c)))


def load(spark: SparkSession, dataset: str, path: str) -> DataFrame | None:
    """(text, label) of a known dataset; None for others."""
    if dataset in ("ag_news", "piidocs"):
        return tsv(spark, path)
    if dataset == "samsum":
        return json_array(spark, path)
    if dataset == "synthpai":
        return comments(users(spark, path)).select("text", F.lit(None).cast("string").alias("label"))
    return None


def vectors(spark: SparkSession, path: str, dims: int, corpus: DataFrame | None = None, alphabetic: bool = False) -> DataFrame:
    """(cand, vec) of a text file `word x1 x2 ...`: lines of another length (headers) are skipped, a word's first line counts.
    corpus (word): only its words. alphabetic: only words of letters."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    parts = lines.select("n", F.split(F.rtrim("value"), " ").alias("p")).where(F.size("p") == dims + 1)
    rows = parts.select("n", nfd(F.get("p", F.lit(0))).alias("cand"), F.slice("p", 2, dims).cast("array<float>").alias("vec"))
    if alphabetic:
        rows = rows.where(F.col("cand").rlike(r"^\p{L}+$"))
    if corpus is not None:
        rows = rows.join(corpus.select(F.col("word").alias("cand")).distinct(), "cand", "left_semi")
    return rows.groupBy("cand").agg(F.min_by("vec", "n").alias("vec"))


@F.pandas_udf(T.StringType())
def nfd(texts: pd.Series) -> pd.Series:
    """Canonical decomposition; Spark has no function for it."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


def results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Result files of a glob, with the file that each row came from."""
    return spark.read.option("header", True).option("recursiveFileLookup", True).option("multiLine", True).option("escape", '"').schema(schema).csv(pattern).withColumn("file", F.input_file_name())


def splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Splits of a dataset as one, with their names."""
    out = None
    for name, part in parts.items():
        part = part.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def unsanitized(docs: DataFrame) -> DataFrame:
    """The control: each text as its own perturbation."""
    return docs.select("text", F.col("label").alias("ground_truth"), F.col("text").alias("perturbed_sentence"))


def prompt(*parts: Column) -> Column:
    """What a denoising model is asked: original, perturbed text and answer under headings."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{h}:\n"), F.coalesce(p, F.lit(""))) for h, p in zip(("Original", "Perturbed", "Response"), parts, strict=False)])


def streamed_reply(reply: Column) -> Column:
    """The text of a reply that came as lines of JSON with a piece each."""
    return F.array_join(F.transform(F.split(reply, "\n"), lambda x: F.coalesce(F.get_json_object(x, "$.response"), F.lit(""))), "")
