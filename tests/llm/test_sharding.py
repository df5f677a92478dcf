"""The k-d tree of shards against one grown in plain Python, and its law on hot and odd tables."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenveil.llm import queries, sharding
from tests.llm.edge import EDGE, clashing

SF = "/root/testdata/sf0.001"


def tree(rows, dims, numeric, shards):
    """Shard of each row (size, c, t, r), by sorting."""
    import math

    at = [(math.log1p if n else float) for n in numeric]
    whole = [max(1e-9, at[i](max(r[1][i] for r in rows)) - at[i](min(r[1][i] for r in rows))) for i in range(dims)]
    out = {}

    def split(part, k, first):
        if k == 1 or not part:
            for r in part:
                out[r[3]] = first
            return
        wide = [(at[i](max(r[1][i] for r in part)) - at[i](min(r[1][i] for r in part))) / whole[i] for i in range(dims)]
        d = max(range(dims), key=lambda i: (wide[i], -i), default=None)
        part = sorted(part, key=lambda r: (r[1][d] if dims else 0, r[2], r[3]))
        total, below, left = sum(r[0] for r in part), 0, 0
        for r in part:
            if (2 * below + r[0]) * k <= 2 * total * (k // 2):
                left += 1
            below += r[0]
        split(part[:left], k // 2, first)
        split(part[left:], k - k // 2, first + k // 2)

    split(rows, shards, 0)
    return out


def lawful(got, shards):
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    mean, largest = sum(sizes.values()) / shards, max(r["size"] for r in got)
    assert all(abs(sizes[s] - mean) <= largest for s in range(shards))


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    more = [(i, t, None if i == 3 else "x" * (i or 0), "src0" if i != 7 else None, None if t is None else len(t)) for i, t in EDGE]
    hot = [(77, "a copy of which there are many", "en", "src1", 31)] * 150 + [(1000 + i, "another text", "en", "hot", 12) for i in range(150)]
    return given.unionByName(spark.createDataFrame(more + hot, given.schema)).repartition(5).cache()


@pytest.mark.parametrize(("dims", "shards"), [(("lang", "source", "n_chars"), 8), (("n_chars",), 5), ((), 3), (("source", "lang"), 1), (("lang",), 20)])
def test_tree(docs, dims, shards, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 50)
    rows, grown = sharding.planned(docs, dims, shards, None, False)
    points = [(r["size"], r["c"], r["t"], r["r"]) for r in rows.collect()]
    got = {r["r"]: r["shard"] for r in sharding.with_shard(rows, grown).collect()}
    assert got == tree(points, len(dims), [d == "n_chars" for d in dims], shards)


def test_law(docs):
    got = sharding.sharded(docs, 8).collect()
    lawful(got, 8)
    want = sorted((repr(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want


def test_same_in_every_partitioning(docs):
    rows = lambda d: sorted(map(repr, sharding.sharded(d, 8).collect()))
    assert rows(docs) == rows(docs.repartition(3, "source"))


def test_query(spark):
    got = queries.op11_sharding(spark, SF).collect()
    lawful(got, 8)
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_copies_only(spark):
    """One row, repeated; fewer rows than shards; none."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    lawful(sharding.sharded(spark.createDataFrame([(1, "same", "en", "s", 4)] * 800, kind).repartition(4)).collect(), 8)
    few = sharding.sharded(spark.createDataFrame([(1, "a", None, None, None), (2, None, None, None, None)], kind)).collect()
    assert len(few) == 2 and len({r["shard"] for r in few}) == 2
    assert sharding.sharded(spark.createDataFrame([], kind)).collect() == []


def test_other_metadata(spark):
    """Fractions, negative and infinite numbers, long shared beginnings, dates."""
    rows = [(i, f"text {i}", (i * 37 % 101) / 101 - 0.5 if i % 9 else float("nan"), f"https://example.org/{i * 53 % 97:03d}", None if i % 11 == 0 else f"2024-01-{i % 28 + 1:02d}") for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, "t", float("inf"), "https://", None)], "doc_id long, text string, score double, url string, day string").withColumn("day", F.to_date("day"))
    for dims in (("score",), ("url",), ("day",), ("day", "url", "score")):
        lawful(sharding.sharded(docs, 8, dims).collect(), 8)
        p = {r["doc_id"]: r["c"] for r in sharding.points(docs, dims).collect()}
        if dims == ("score",):
            order = sorted((r for r in rows if r[2] == r[2]), key=lambda r: r[2])
            assert all(p[a[0]][0] < p[b[0]][0] for a, b in zip(order, order[1:], strict=False) if a[2] < b[2])


def test_write(spark, docs, tmp_path):
    name = sharding.write_shards(clashing(docs), f"{tmp_path}/out", target_bytes=40_000)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert name == "_shard" and set(out.columns) == {*clashing(docs).columns, "_shard"}
    assert out.count() == docs.count() and out.where("text = 'another text' AND shard = 'own'").count() == 150
    total = sum(len((r["text"] or "").encode()) + 1 for r in docs.collect())
    assert out.select("_shard").distinct().count() == -(-total // 40_000)
