"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard verification, union-find; DataFrame functions only."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialize, row_key, swept
from .quality import bind

#: Buckets of the table of rarity, as a power of two: 128 KB.
BUCKET_BITS = 17


@dataclass(frozen=True)
class Lines:
    """chars: characters of a shingle; one starts at each character. rows: minwise shingles of a band. bands: of a line; with 3 and 6,
    a pair of similarity 0.8 shares a band with probability 0.986, one of 0.9 with 0.9996. least: similarity in hundredths.
    small: lines of a band that are all held against each other; larger bands go another way, which finds the same: lines
    go against `hubs` of the largest component that they meet there, then all pairs that are left."""

    chars: int = 12
    rows: int = 3
    bands: int = 6
    least: int = 80
    small: int = 24
    hubs: int = 8


def shingle_set(line: Column, chars: int) -> Column:
    """The set of a line's shingles, each as 64 bits of hash: stretches of `chars` characters, from every position on; a shorter
    line is one stretch. In UTF-32 a stretch of characters is one of bytes, which is cut out at once wherever it stands."""
    each = lambda u: F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(u) / 4 - chars, F.lit(0)).cast("int")), lambda i: F.xxhash64(F.substring(u, 4 * i + 1, F.lit(4 * chars))))
    return F.array_distinct(bind(F.encode(line, "UTF-32"), each))


def shingle_rows(lines: DataFrame, chars: int) -> DataFrame:
    """(h, g, i, x): a row for each shingle of lines (h, g, line), from its place i on, x its hash; in compiled loops, with no
    array of shingles."""
    wide = lines.select("h", "g", F.encode("line", "UTF-32").alias("u"))
    last = F.greatest(F.octet_length("u") / 4 - chars, F.lit(0)).cast("int")
    each = wide.select("h", "g", "u", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return each.select("h", "g", "i", F.xxhash64(F.expr(f"substring(u, 4 * i + 1, {4 * chars})")).alias("x"))


def signatures(lines: DataFrame, config: Lines) -> DataFrame:
    """(h, g, n, bands): each different line, how often it is there, and its bands. Hashed shingles are dealt into rows * bands
    bins, of which each holds its least one (MinHash by one permutation); an empty bin takes the next full one's. `rows` bins
    are a band."""
    k = config.rows * config.bands
    each = shingle_rows(lines, config.chars).withColumn("bin", F.pmod("x", F.lit(k)))
    least = each.groupBy("h", "g").agg(F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).alias("n"), *[F.min(F.when(F.col("bin") == j, F.col("x"))).alias(f"m{j}") for j in range(k)])
    full = least.select("h", "g", "n", *[F.coalesce(*[f"m{(j + i) % k}" for i in range(k)]).alias(f"m{j}") for j in range(k)])
    return full.select("h", "g", "n", F.array(*[F.xxhash64(F.lit(b), *[f"m{b * config.rows + r}" for r in range(config.rows)]) for b in range(config.bands)]).alias("bands"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line_no, line, h, g): the lines of docs (doc_id, text) that have a word, with 128 bits of hash."""
    lines = docs.select("doc_id", row_key().alias("key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})


def alike(one: Column, two: Column, config: Lines) -> Column:
    """The Jaccard similarity of two lines' sets of shingles is `least` hundredths or more. Each set is made once."""
    sets = F.struct(*[shingle_set(x, config.chars).alias(k) for k, x in (("x", one), ("y", two))])
    sizes = bind(sets, lambda v: F.struct((F.size(v["x"]) + F.size(v["y"])).alias("n"), F.size(F.array_intersect(v["x"], v["y"])).alias("c")))
    return bind(sizes, lambda v: 100 * v["c"] >= config.least * (v["n"] - v["c"]))


def linked(pairs: DataFrame, texts: DataFrame, config: Lines) -> DataFrame:
    """Those of pairs (a, b) of lines (id, line) whose sets of shingles are similar enough."""
    pairs = materialize(pairs.distinct(), "line-pairs")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("one")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("two")), "b")
    links = materialize(both.where(alike(F.col("one"), F.col("two"), config)).select("a", "b"), "line-links")
    discard(pairs)
    return links


def groups(lines: DataFrame, marked: DataFrame, config: Lines) -> DataFrame:
    """(id, root): the lines (h, g, line) that have a link, by 128 bits of hash, and the least one that links lead to.

    The lines of a band are held against its least one first. Where that leaves several components in a band, all pairs of
    different components of a small band are compared; lines of larger bands go through an exact join together: two
    lines alike share one of their rarest shingles (prefixes()). So each pair that shares a band is compared or already
    linked through others. What a round links needs no more comparison in the next.
    """
    band = marked.select("h", "g", F.explode("bands").alias("band"))
    met = band.groupBy("band").agg(F.count("*").alias("n"), F.min("h").alias("h"), F.min_by("g", "h").alias("g"), F.max("h").alias("h2"), F.max_by("g", "h").alias("g2")).where("n > 1")
    met = materialize(met.select("band", "n", F.struct("h", "g").alias("least"), F.struct(F.col("h2").alias("h"), F.col("g2").alias("g")).alias("most")), "line-met")
    swept(lines.sparkSession)
    members = materialize(band.join(met.where("n > 2").select("band", "n", "least"), "band").select("band", "n", "least", F.struct("h", "g").alias("id")), "line-members")
    two = met.where("n = 2")
    need = members.select("id").union(two.select("least")).union(two.select("most")).distinct().select("id.*")
    texts = lines.select("h", "g", "line").join(need, ["h", "g"]).groupBy("h", "g").agg(F.min("line").alias("line"))
    texts = materialize(texts.select(F.struct("h", "g").alias("id"), "line"), "line-texts")
    swept(lines.sparkSession)
    star = two.select(F.col("most").alias("a"), F.col("least").alias("b")).union(members.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    links = linked(star, texts, config)
    discard(met)
    root = components(links, "line")
    discard(links)
    members, last = materialize(mixed(rooted_lines(members.select("band", "n", "id"), root), "band"), "line-members"), members
    discard(last)
    some = members.where(F.col("n") <= config.small).groupBy("band").agg(F.sort_array(F.collect_list(F.struct("id", "root"))).alias("m"))
    first = some.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter("m", lambda y: (y["id"] > F.col("x.id")) & (y["root"] != F.col("x.root")))).alias("y"))
    pairs = first.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"))
    posts = None
    wide = members.where(F.col("n") > config.small).select("id").distinct()
    if wide.head(1):
        posts = prefixes(texts.join(wide, "id"), config)
        hubs = mixed(rooted_lines(posts, root), "t").join(posts.groupBy("t").agg(F.min("id").alias("least")), "t").where("id <> least")
        pairs = pairs.union(hubs.select(F.col("id").alias("a"), F.col("least").alias("b")))
    root = with_links(linked(pairs, texts, config), root)
    discard(members)
    if posts is not None:
        left = lambda: materialize(mixed(rooted_lines(posts.drop("root"), root), "t"), "line-posts")
        posts, last = left(), posts
        discard(last)
        if crowded(posts):
            root = with_links(linked(met_in_main(posts, config), texts, config), root)
            posts, last = left(), posts
            discard(last)
        root = with_links(linked(met_in_prefixes(posts, config), texts, config), root)
        discard(posts)
    discard(texts)
    return root


def with_links(links: DataFrame, root: DataFrame) -> DataFrame:
    if links.head(1):
        root, last = components(links, "line", root), root
        discard(last)
    discard(links)
    return root


def surplus(docs: DataFrame, config: Lines = Lines()) -> DataFrame:
    """(doc_id, key, line_no, kept_doc_id, kept_line_no): each line that goes, with the line of its component that stays.

    Lines are alike if they are equal, or if the Jaccard similarity of their shingles is `least` hundredths or more; the first
    line of a component stays, by (doc_id, key, line_no). Blank lines are left alone, and null texts have no lines.
    Rows that repeat in full share all their lines and their fate: they are the same place. Null doc_ids come first.

    Equal lines are one from the start, summed up before the shuffle, so a line that a third of the rows have costs a row.
    """
    lines = lines_of(docs)
    marked = materialize(signatures(lines, config), "line-bands")
    swept(docs.sparkSession)
    root = groups(lines, marked, config)
    # The lines that are there twice or have a link; only their places are looked at.
    some = marked.where("n > 1").select("h", "g").join(root.select(F.col("id.h").alias("h"), F.col("id.g").alias("g"), "root"), ["h", "g"], "full")
    some = some.withColumn("root", F.coalesce("root", F.struct("h", "g")))
    place = F.struct("doc_id", "key", "line_no")
    places = materialize(lines.select("doc_id", "key", "line_no", "h", "g").join(some, ["h", "g"]).select("doc_id", "key", "line_no", "root"), "line-places")
    discard(marked, root)
    swept(docs.sparkSession)
    kept = materialize(places.groupBy("root").agg(F.min(place).alias("kept")), "line-kept")
    gone = places.join(kept, "root").where(~place.eqNullSafe(F.col("kept")))
    return gone.select("doc_id", "key", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no")).distinct()


def rooted_lines(lines: DataFrame, root: DataFrame) -> DataFrame:
    return lines.join(root.select("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def mixed(rooted: DataFrame, by: str) -> DataFrame:
    """Rows whose group has lines of several components."""
    several = rooted.groupBy(by).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select(by)
    return rooted.join(several, by, "left_semi")


def prefixes(lines: DataFrame, config: Lines) -> DataFrame:
    """(t, id, n, i, before): the rarest shingles of lines (id, line), by hash, with their place among the line's n by rarity and
    the three that come before them; those that no other line has are left out.

    Two sets of similarity `least` hundredths or more share a member of both prefixes of n * (100 - least) / 100 + 1 members,
    in any one order of all members; the rarest first makes the fewest meet. Rarity is counted by bucket of shingles, a byte
    for each (the logarithm), so that the table has one size for any corpus and needs no join.
    """
    bucket = lambda x: F.shiftright(x, 64 - BUCKET_BITS) + (1 << (BUCKET_BITS - 1))
    each = shingle_rows(lines.select("id.*", "line"), config.chars)
    often = bytearray(1 << BUCKET_BITS)
    for r in each.groupBy(bucket(F.col("x")).alias("b")).agg(F.count("*").alias("n")).toLocalIterator():
        often[r["b"]] = min(255, int(8 * math.log2(1 + r["n"])))
    table = F.lit(often)
    rarity = lambda x: F.struct(F.substring(table, (bucket(x) + 1).cast("int"), F.lit(1)).alias("f"), x.alias("t"))
    first = lambda s: F.slice(s, 1, F.floor(F.size(s) * (100 - config.least) / 100).cast("int") + 1)
    of = lambda s: F.struct(F.size(s).alias("n"), F.transform(first(s), lambda x: x["t"]).alias("p"))
    # Written before they are taken apart, or each set would be made anew for each use of it.
    listed = materialize(lines.select("id", bind(F.array_sort(F.transform(shingle_set(F.col("line"), config.chars), rarity)), of).alias("v")), "line-sorted")
    some = listed.select("id", "v.n", "v.p", F.posexplode("v.p").alias("i", "t"))
    own = materialize(some.select("t", "id", "n", "i", F.slice("p", F.greatest(F.col("i") - 2, F.lit(1)), F.least(F.col("i"), F.lit(3))).alias("before")), "line-prefixes")
    discard(listed)
    shared = own.groupBy("t").agg(F.count("*").alias("f")).where("f > 1").select("t")
    posts = materialize(own.join(shared, "t", "left_semi"), "line-posts")
    discard(own)
    return posts


def crowded(posts: DataFrame) -> bool:
    """Whether all pairs of lines of different components that share a prefix member are more than twice the posts."""
    share = posts.groupBy("t", "root").agg(F.count("*").alias("c"))
    each = share.groupBy("t").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
    total = each.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs"), F.sum("n").alias("n")).first()
    return (total["pairs"] or 0) > 2 * (total["n"] or 0)


def met_in_main(posts: DataFrame, config: Lines) -> DataFrame:
    """Pairs (a, b) of each line with `hubs` lines of the largest component among those that share a prefix member with it, if
    it is in another: a few pairs for a post. Near copies of one text become one component by them, without their square."""
    one = [F.min_by(F.struct("id", "n", "i"), F.xxhash64("id", F.lit(k))) for k in range(config.hubs)]
    share = posts.groupBy("t", "root").agg(F.count("*").alias("c"), F.array_distinct(F.array(*one)).alias("hubs"))
    main = share.groupBy("t").agg(F.max_by(F.struct("root", "hubs"), F.struct("c", "root")).alias("m"))
    met = posts.join(main, "t").where(F.col("root") != F.col("m.root")).select("id", F.col("n").alias("x"), F.col("i").alias("j"), F.explode("m.hubs").alias("hub"))
    return met.where(enough(config, F.col("hub.n"), F.col("hub.i"))).select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct()


def enough(config: Lines, y: Column, k: Column) -> Column:
    """What follows from places j and k on in sets of x and y members can make them alike."""
    return (100 + config.least) * F.least(F.col("x") - F.col("j"), y - k) >= config.least * (F.col("x") + y)


def met_in_prefixes(posts: DataFrame, config: Lines) -> DataFrame:
    """Pairs (a, b) of lines of different components that share a prefix member and whose sets can still be alike: what they
    share stands from their first common member on. Where what comes before a member is common to both as well, the pair
    has been met there: lines that share a run of members meet once, not at each."""
    one, two = posts.select("t", F.col("id").alias("a"), F.col("root").alias("p"), F.col("n").alias("x"), F.col("i").alias("j"), F.col("before").alias("u")), posts.select("t", F.col("id").alias("b"), F.col("root").alias("q"), F.col("n").alias("y"), F.col("i").alias("k"), F.col("before").alias("v"))
    return one.join(two, "t").where((F.col("a") > F.col("b")) & (F.col("p") != F.col("q")) & enough(config, F.col("y"), F.col("k")) & ~F.arrays_overlap("u", "v")).select("a", "b").distinct()


def without_surplus(docs: DataFrame, config: Lines = Lines()) -> DataFrame:
    """Rows of docs, all columns, with surplus lines out of `text` and n_chars, where there is one, counted anew.

    A document that loses its last line with a word goes; one that had none before stays as it is.
    """
    doc, key, gone, new = (f"_{x}{uuid.uuid4().hex}" for x in ("doc", "key", "gone", "text"))
    lines = surplus(docs, config).groupBy(F.col("doc_id").alias(doc), F.col("key").alias(key)).agg(F.sort_array(F.collect_list("line_no")).alias(gone))
    keyed = docs.withColumn(f"{key}_own", row_key())
    joined = keyed.join(lines, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(f"{key}_own") == F.col(key)), "left")
    # Stretches between the lines that go are sliced out: the work is in proportion to the lines, whatever goes.
    left = bind(
        F.struct(F.split("text", "\n").alias("s"), F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(F.split("text", "\n")))).alias("g")),
        lambda v: F.array_join(F.flatten(F.transform(F.slice(v["g"], 2, F.size(v["g"]) - 1), lambda e, i: F.slice(v["s"], F.get(v["g"], i) + 2, e - F.get(v["g"], i) - 1))), "\n"),
    )
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)
    out = joined.withColumn(new, text).where(F.col(gone).isNull() | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col(new).alias("text") if c == "text" else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)
