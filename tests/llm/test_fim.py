"""Fill-in-middle: cuts, forms and the way back against plain Python."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenveil.llm import fim, queries
from tests.llm.edge import EDGE, clashing

SF = "/root/testdata/sf0.001"


def want(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    i, j = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    pre, mid, suf = text[:i], text[i:j], text[j:]
    if d % 100 < 20:
        return doc_id, n, "spm", i, j - i, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", i, j - i, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def rows(spark):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return given + EDGE + [(100_000 + i, t) for i in range(30) for t in (EDGE[13][1] * 300, EDGE[14][1], EDGE[15][1])]


@pytest.mark.parametrize("chunk", [7, 4096])
def test_outputs(spark, rows, chunk):
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    made = fim.rearranged(docs, chunk=chunk)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(repr(want(*r)) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["back"]) for r in got if r["doc_id"] is not None) == sorted((False, d, t or "") for d, t in rows if d is not None)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_query(spark):
    got = queries.op13_fill_in_middle(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(*want(r["doc_id"], r["text"])[:5], sha(want(r["doc_id"], r["text"])[5]), sha(r["text"] or "")) for r in rows]
    assert sorted(tuple(r) for r in got if r["prefix_chars"] is not None) == sorted(r for r in expected if r[3] is not None)
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, expected))


def test_empty(spark):
    assert fim.rearranged(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_shuffle(spark):
    plan = fim.rearranged(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("unit", ["character", "word", "line"])
@pytest.mark.parametrize("chunk", [1, 5, 64])
def test_chunks(unit, chunk):
    """Units of every kind and the bytes before each rank, whatever the chunks; also for a part of a column."""
    rng = np.random.default_rng(4)
    texts = ["", None, "é", *["".join(rng.choice(list("ab \n\té😀"), rng.integers(1, 200))) for _ in range(40)]]

    def starts(t):
        raw = (t or "").encode()
        if unit == "character":
            own = [i for i, b in enumerate(raw) if b & 0xC0 != 0x80]
        elif unit == "word":
            own = [i for i in range(len(raw)) if i == 0 or (raw[i - 1 : i] in (b" ", b"\n", b"\t") and raw[i : i + 1] not in (b" ", b"\n", b"\t"))]
        else:
            own = [i for i in range(len(raw)) if i == 0 or raw[i - 1] == 10]
        return own, len(raw)

    for column, expected in ((pa.array(texts, pa.string()), texts), (pa.array(texts, pa.string()).slice(3, 20), texts[3:23])):
        chunks = fim.Chunks(column, unit, chunk)
        for i, t in enumerate(expected):
            own, size = starts(t)
            assert chunks.n[i] == len(own)
            assert [chunks.cut(i, r) for r in range(len(own) + 1)] == own + [size]
