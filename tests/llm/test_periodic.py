"""Periodic runs against all stretches of all periods."""

import hashlib
import time
import zlib

import numpy as np
import pytest

from lumenveil.llm import periodic, queries
from tests.llm.edge import EDGE, clashing

SF = "/root/testdata/sf0.001"


def brute(w, least=6, times=4):
    """Every maximal stretch of every period; a stretch counts at its smallest period only."""
    seen = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                seen.setdefault((i, j + p - i), p)
            i = j + 1
    # A stretch that a smaller period also has is that period's run, found there with the same ends.
    return sorted((s, n, p) for (s, n), p in seen.items())


def numbers(w):
    index = {}
    return np.array([index.setdefault(x, len(index)) for x in w], np.int32)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
@pytest.mark.parametrize("tile", [8, 1 << 17])
def test_random(letters, tile, monkeypatch):
    monkeypatch.setattr(periodic, "TILE", tile)
    monkeypatch.setattr(periodic, "STRIDE", 3)
    rng = np.random.default_rng(letters)
    for _ in range(150):
        w = list(rng.integers(0, letters, rng.integers(0, 90)))
        for _ in range(rng.integers(0, 3)):
            block = list(rng.integers(0, letters, rng.integers(1, 12)))
            at = rng.integers(0, len(w) + 1)
            w[at:at] = (block * 9)[: rng.integers(1, 9 * len(block) + 1)]
        assert periodic.runs_of(numbers(w)) == brute(w)


def test_nested_periods():
    """Runs inside the periods of longer runs, Fibonacci words, one word only."""
    inner = list("ababababx")
    f = ["a", "ab"]
    while len(f[-1]) < 600:
        f.append(f[-1] + f[-2])
    for w in (inner * 7, (inner * 5 + ["y"]) * 5, list(f[-1]), ["a"] * 500, list("aab") * 100 + ["a"] * 9, list("abcabcabcabcab")):
        assert periodic.runs_of(numbers(w)) == brute(w)


def test_long_texts_take_near_linear_time():
    """A run over all words, and a long text of two words at random; the first would take the square of its length if multiples were probed."""
    rng = np.random.default_rng(0)
    began = time.time()
    assert periodic.runs_of(np.zeros(300_000, np.int32)) == [(0, 300_000, 1)]
    assert periodic.runs_of(np.tile(np.arange(1000, dtype=np.int32), 300)) == [(0, 300_000, 1000)]
    assert periodic.runs_of(rng.integers(0, 50_000, 300_000).astype(np.int32)) == []
    assert time.time() - began < 30


def rewritten(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def want(doc_id, text):
    w = rewritten(doc_id, text)
    runs = brute(w) if len(w) < 2500 else periodic.runs_of(numbers(w))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    stays = [x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best[i] if best else None for i in (0, 1, 2)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(stays)))


def test_query(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in EDGE[:12] if i] + EDGE
    rows += [(i, "p q r s t u v w") for i in range(20_000, 20_200)] + [(20_300, " ".join(["ha"] * 9 + ["x", "y"] * 5))]
    clashing(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(want(*r)) for r in rows)
    assert sum(r["n_runs"] for r in got) > 20


def test_runs_and_texts(spark):
    text = " ".join(["go", "on"] * 5 + ["then", "stop"])
    got = periodic.periodic_runs(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got[0]["runs"]] == [(0, 10, 2)] and got[0]["collapsed"] == "go on then stop"
    assert got[1]["runs"] == [] and got[1]["collapsed"] == ""
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), times=3)


def test_no_shuffle(spark):
    plan = queries.op12_periodic_runs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
