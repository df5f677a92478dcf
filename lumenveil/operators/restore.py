"""Groups of changed tokens, and originals put back into responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import resources as R
from ..functions.tokens import CJK, repaired


def change_groups(tokens: DataFrame) -> DataFrame:
    """(doc_id, index, original, perturbed, original_tokens, perturbed_tokens, indices, regex_pattern, sub_changes): each run of
    neighbouring tokens (doc_id, pos, token, new_token) that changed."""
    changed = tokens.where("token <> new_token")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    item = F.struct("pos", F.col("token").alias("o"), F.col("new_token").alias("p"))
    runs = changed.withColumn("_island", island).groupBy("doc_id", "_island").agg(F.sort_array(F.collect_list(item)).alias("g"))
    plain = lambda x: F.replace(x, F.lit("##"), F.lit(""))
    text = lambda part: F.replace(F.replace(F.array_join(F.transform("g", lambda x: x[part]), " "), F.lit(" ##"), F.lit("")), F.lit("##"), F.lit(""))
    put = F.regexp_replace(repaired(text("p")), r"(?<=\d)\s+(?=\d)", "")
    out = runs.select("doc_id", F.get("g", F.lit(0))["pos"].alias("index"), text("o").alias("original"), put.alias("perturbed"), "g")
    return out.select(
        "doc_id", "index", "original", "perturbed", F.transform("g", lambda x: plain(x["o"])).alias("original_tokens"), F.transform("g", lambda x: plain(x["p"])).alias("perturbed_tokens"),
        F.transform("g", lambda x: x["pos"]).alias("indices"), flexible(F.col("perturbed")).alias("regex_pattern"), F.transform("g", lambda x: F.struct(plain(x["o"]).alias("original"), plain(x["p"]).alias("perturbed"))).alias("sub_changes"),
    )


def flexible(text):
    """A pattern for a text whose atoms, Chinese characters and other words, may be parted by blanks and light punctuation."""
    atoms = F.regexp_extract_all(text, F.lit(rf"{CJK}|(?:(?!{CJK})\S)+"), F.lit(0))
    quoted = F.transform(atoms, lambda a: F.regexp_replace(a, r"([^\p{L}\p{N}_])", r"\\$1"))
    pattern = F.array_join(quoted, r"[\s\-_,.]*")
    return F.when(F.btrim(text).rlike("^[a-zA-Z]{1,3}$"), F.concat(F.lit(r"\b"), pattern, F.lit(r"\b"))).otherwise(pattern)


def literal(text):
    """A replacement of a regular expression that stands for itself."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def put_back(response, change):
    """A response with one change taken back: wherever its pattern matches, else wherever its text stands, else each of its telling
    words by itself. Case doesn't matter to patterns and to plain words."""
    original = F.regexp_replace(change["original"], rf"(?<={CJK})\s+(?={CJK})", "")
    pattern = F.concat(F.lit("(?iU)"), change["regex_pattern"])

    def word(text, sub):
        old, plain = sub["perturbed"], sub["perturbed"].rlike("^[a-zA-Z0-9]+$")
        idle = (F.length(old) < 2) | F.lower(old).isin(sorted(R.SHORT_STOP)) | (old.rlike("^[a-zA-Z]+$") & (F.length(old) < 4))
        edged = F.regexp_replace(text, F.concat(F.lit(r"(?iU)\b"), old, F.lit(r"\b")), literal(sub["original"]))
        return F.when(idle, text).when(plain, edged).otherwise(F.replace(text, old, sub["original"]))

    matched = (change["regex_pattern"] != "") & F.rlike(response, pattern)
    whole = (change["perturbed"] != "") & F.contains(response, change["perturbed"])
    by_word = F.aggregate(F.coalesce(change["sub_changes"], F.array().cast("array<struct<original:string,perturbed:string>>")), response, word)
    return F.when(matched, F.regexp_replace(response, pattern, literal(original))).when(whole, F.replace(response, change["perturbed"], original)).otherwise(by_word)


def restore(responses: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, restored) for responses (doc_id, response) and change groups; responses without changes stay, null ones too.

    A document's changes meet its response by one join. They are taken back by a fold over them, the longest perturbed text
    first, of equally long ones the first in the text; each sees what those before it left."""
    item = F.struct((-F.length("perturbed")).alias("order"), "index", "original", "perturbed", "regex_pattern", "sub_changes")
    gathered = groups.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("changes"))
    joined = responses.select("doc_id", "response").join(gathered, "doc_id", "left")
    put = F.when(F.col("changes").isNull(), F.col("response")).otherwise(F.aggregate("changes", F.col("response"), put_back))
    return joined.select("doc_id", put.alias("restored"))
