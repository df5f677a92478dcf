"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lumenveil.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in catalogue.SQL:
        assert got
        return
    r = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(plain(row[names.index(c)]) for c in cols)) for row in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_edit_distance_by_characters(spark, duck):
    """The query's SQL counts bytes of recoded texts; plain Python counts characters."""

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    items = dict(duck.execute("SELECT item_id, lower(text) FROM benchmark").fetchall())
    want = {i: 1 - distance(a, items[i + 1]) / max(len(a), len(items[i + 1])) for i, a in items.items() if i + 1 in items}
    got = dict(tuple(r) for r in catalogue.QUERIES["levenshtein_sim_all"](spark, SF).select("item_id", "sim").collect())
    assert set(got) == set(want) and all(abs(got[i] - v) < 1e-8 for i, v in want.items())


@pytest.mark.parametrize("missing", ["public_tokenizers", "lumenveil.llm"])
def test_entry_without_corpus_operators(missing, monkeypatch):
    """Without a module that the corpus operators need, the other queries stay."""
    import sys

    for name in [m for m in sys.modules if m.startswith(("lumenveil.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.SQL)
