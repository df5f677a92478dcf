"""WARC records of pages, and a Merkle audit of replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Pages of one file, and children of a node, as powers of two.
FILE_BITS, FAN_BITS = 12, 4


def record(url: Column, page_id: Column, body: Column) -> Column:
    """The bytes of a page's record, as a string."""
    crlf, body = "\r\n", F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.0{crlf}WARC-Type: resource{crlf}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{crlf}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{crlf}Content-Type: text/html{crlf}Content-Length: "), F.octet_length(body).cast("string"), F.lit(f"{crlf}{crlf}"), body, F.lit(f"{crlf}{crlf}"),
    )


def leaves(pages: DataFrame) -> DataFrame:
    """(file_no, idx, page_id, n_records, offset, length, digest): a leaf for each page_id of pages (page_id, url, html).

    A file holds the page_ids of one range of 4096, records in order. Records are hashed where they lie; only lengths and
    digests are shuffled. Several records of an id are first summed up by what they hold, so an id that a third of the rows
    have costs a row for each different record; the leaf then hashes the sorted list of (length, digest, count), in 256 parts
    by digest. Any change of one or more of them changes the leaf.
    Null page_ids form a file of their own (file_no null, idx 0); null urls and bodies are empty.
    """
    hashed = pages.select("page_id", record(F.col("url"), F.col("page_id"), F.col("html")).alias("r")).select("page_id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("d"))
    kinds = hashed.groupBy("page_id", "length", "d").agg(F.count("*").alias("c"))
    part = kinds.withColumn("p", F.substring("d", 1, 2)).groupBy("page_id", "p").agg(F.sum("c").alias("c"), F.sum(F.col("length") * F.col("c")).alias("length"), F.sort_array(F.collect_list(F.struct("length", "d", "c"))).alias("l"))
    part = part.select("page_id", "c", "length", F.when((F.size("l") == 1) & (F.col("c") == 1), F.col("l")[0]["d"]).otherwise(F.sha2(F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["length"], x["d"], x["c"])), ","), 256)).alias("d"), "p")
    found = part.groupBy("page_id").agg(F.sum("c").alias("n_records"), F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("p", "d"))).alias("l"))
    one = F.when(F.size("l") == 1, F.col("l")[0]["d"]).otherwise(F.sha2(F.array_join(F.transform("l", lambda x: x["d"]), ","), 256))
    return found.select(F.shiftright("page_id", FILE_BITS).alias("file_no"), F.coalesce(F.col("page_id").bitwiseAND(F.lit((1 << FILE_BITS) - 1)), F.lit(0)).alias("idx"), "page_id", "n_records", "length", one.alias("digest"))


def offsets(found: DataFrame) -> DataFrame:
    """Adds each leaf's offset in its file: the bytes of the leaves before it. A file has 4096 leaves at most."""
    from pyspark.sql import Window

    before = Window.partitionBy("file_no").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above (file_no, idx, lo, hi, digest): a node covers the bytes lo to hi of its file and hashes its children's places,
    ranges and digests in order, 16 at most. Ranges count from the node's own start, so that a change of length moves
    nothing outside the branch that it lies in."""
    up = nodes.groupBy("file_no", F.shiftright("idx", FAN_BITS).alias("up"))
    kids = up.agg(F.sort_array(F.collect_list(F.struct("idx", "lo", "hi", "digest"))).alias("kids"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    child = lambda k: F.concat_ws(":", k["idx"], k["lo"] - F.col("lo"), k["hi"] - F.col("lo"), k["digest"])
    return kids.select("file_no", F.col("up").alias("idx"), "lo", "hi", F.sha2(F.array_join(F.transform("kids", child), "\n"), 256).alias("digest"))


def differing(left: DataFrame, right: DataFrame, among: DataFrame | None) -> DataFrame:
    """Nodes (file_no, idx) of one level that only one side has or whose digests differ; of parents `among` only."""
    if among is not None:
        left, right = (x.join(among.select(F.col("file_no").alias("_f"), F.col("idx").alias("_i")), F.col("file_no").eqNullSafe(F.col("_f")) & (F.shiftright("idx", FAN_BITS) == F.col("_i")), "left_semi") for x in (left, right))
    r = right.select(F.col("file_no").alias("r_file"), F.col("idx").alias("r_idx"), F.col("digest").alias("r_digest"))
    both = left.select("file_no", "idx", "digest").join(r, F.col("file_no").eqNullSafe(F.col("r_file")) & (F.col("idx") == F.col("r_idx")), "full")
    return both.where(~F.col("digest").eqNullSafe(F.col("r_digest"))).select(F.when(F.col("idx").isNull(), F.col("r_file")).otherwise(F.col("file_no")).alias("file_no"), F.coalesce("idx", "r_idx").alias("idx"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, file_no, offset, length, problem, expected, found) of each leaf that differs between two tables of pages.

    problem: damaged, lost (not in the replica) or extra (only there; offset, length and expected are null). Trees of both are built
    level by level; roots are compared first, and then only children of nodes that differ. Equal or empty tables give no rows.
    """
    mine, theirs = (materialize(offsets(leaves(x)), "warc-leaves") for x in (primary, replica))
    sides = []
    for x in (mine, theirs):
        levels = [x.select("file_no", "idx", F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"), "digest")]
        while len(levels) <= FILE_BITS // FAN_BITS:
            levels.append(materialize(parents(levels[-1]), "warc-level"))
        sides.append(levels)
    among = None
    for level in range(FILE_BITS // FAN_BITS, -1, -1):
        among = materialize(differing(sides[0][level], sides[1][level], among), "warc-differ")
    bad = among.select(F.col("file_no").alias("b_file"), F.col("idx").alias("b_idx"))
    placed = mine.select(F.col("file_no").alias("m_file"), F.col("idx").alias("m_idx"), F.col("page_id").alias("m_page"), "offset", "length", F.col("digest").alias("expected"))
    other = theirs.select(F.col("file_no").alias("t_file"), F.col("idx").alias("t_idx"), F.col("page_id").alias("t_page"), F.col("digest").alias("found"))
    joined = bad.join(placed, F.col("b_file").eqNullSafe(F.col("m_file")) & (F.col("b_idx") == F.col("m_idx")), "left").join(other, F.col("b_file").eqNullSafe(F.col("t_file")) & (F.col("b_idx") == F.col("t_idx")), "left")
    problem = F.when(F.col("found").isNull(), "lost").when(F.col("expected").isNull(), "extra").otherwise("damaged")
    return joined.select(F.coalesce("m_page", "t_page").alias("page_id"), F.col("b_file").alias("file_no"), "offset", "length", problem.alias("problem"), "expected", "found")


