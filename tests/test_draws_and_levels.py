"""Draws in the row, merged levels, radius joins, running sums and budgets against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenveil import api
from lumenveil.config import PrivacyConfig
from lumenveil.functions import rng
from lumenveil.functions.spans import OPEN, SHUT, counted
from lumenveil.operators import attacks, corpus, detect, knn, levels, mechanisms, perturb, risk

SF = "/root/testdata/sf0.001"
#: Empty, blank, plain, all personal, touching and nested spans, other digits, emoji, rules inside entities.
EDGE = [
    "", " \n", "x", "no personal data here", "13812345678", "mail a.b@qq.com or 13812345678, 110101199003071234", "+8613812345678 4785380592391139", "电话１３８００１３８０００ 张伟先生 在北京市 王者 200 万人民币",
    "see https://www.qq.com/a/b?x=138123456789 and report.pdf, 2024.docx", "😀😀 13812345678 é12345", "falcon FALCON falcons 13812345678falcon", "the 10.0.0.1 the", "www.falcon.org/13812345678 7", "a@falcon.com" * 3, "1 22 333 " * 200,
]
RULES = [("falcon", 5), ("the", 0), ("8123", 2), ("qq", None), ("com", 1), ("13", 4)]


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def folded(text, entities, rules):
    """Levels of characters, one by one, as a map in which later steps overwrite earlier ones."""
    level, marked, safe = {}, set(), set()
    for word, n in rules:
        for m in re.finditer(re.escape(word), text, re.IGNORECASE):
            for i in range(*m.span()):
                level[i] = max(level.get(i, 0), n or 0)
                marked.add(i)
                if not n:
                    safe.add(i)
    def put(span, n):
        for i in span:
            if i not in marked:
                level[i] = n
    for e in entities:
        span = range(e["start"], e["end"])
        if not safe & set(span):
            put(span, 5)
    for pattern, n in ((r"(?<!\d)1\d{10}(?!\d)", 5), (r"https?://[a-zA-Z0-9./?=&_-]+|www\.[a-zA-Z0-9./?=&_-]+", 3), (r"(?i)[\w]+\.(xlsx|pdf|docx?|pptx?|zip|rar)", 5)):
        for m in re.finditer(pattern, text):
            put(range(*m.span()), n)
    for m in re.finditer(r"\d+", text):
        for i in range(*m.span()):
            if i not in marked and level.get(i, 0) < 3:
                level[i] = 3
    return level


@pytest.mark.parametrize("rules", [[], RULES, [("falcon", 3), ("13812345678", 1), ("mail", 0)]])
def test_merged_levels(spark, rules):
    given = EDGE + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").limit(40).collect()] + [None]
    rows = api.marked_up(texts(spark, *given), rules).orderBy("doc_id").collect()
    assert len(rows) == len(given)
    for r in rows:
        want = folded(r["text"], r["entities"], rules)
        assert r["levels"] == "".join(str(want.get(i, ".")) for i in range(len(r["text"])))
        for t in r["levelled"]:
            own = [want[i] for i in range(t["start"], t["end"]) if i in want]
            assert t["level"] == max(own, default=0)


def test_rules_reach_tokens(spark):
    got = {r["token"]: r["level"] for r in api.analyze(texts(spark, "the falcon flies to 12 towers"), [("falcon", 5), ("tower", 2)]).collect()}
    assert got == {"the": 0, "falcon": 5, "flies": 0, "to": 0, "12": 3, "towers": 2}
    general = {r["token"]: r["level"] for r in api.analyze(texts(spark, "请 看 @ x.com — 1234567 你好"), general=True).collect()}
    assert general["1234567"] == 5 and general["@"] == 0 and "-" in general


def small(spark, n=30):
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "green", "table", "music"]
    vocab = spark.createDataFrame([(w, [math.cos(i), math.sin(i), i / 10]) for i, w in enumerate(words)], "cand string, vec array<double>")
    items = texts(spark, *[" ".join(words[(i * k + k) % 10] for k in range(8)) + f" {i} a@qq.com $ 21st" for i in range(n)])
    return items, vocab


def test_chosen_levels(spark):
    items, vocab = small(spark, 3)
    chosen = spark.createDataFrame([(0, 0, 4), (0, 0, 2), (0, 1, 5), (1, 2, 0), (9, 0, 5)], "doc_id long, pos int, level int")
    rows = api.perturb_chosen(items, vocab, PrivacyConfig(), chosen).orderBy("doc_id", "pos").collect()
    budgeted = {(r["doc_id"], r["pos"]): r["eps"] for r in rows if r["eps"] is not None}
    assert budgeted == {(0, 0): 2.07, (0, 1): 0.1}
    assert all(r["new_token"] == r["token"] for r in rows if (r["doc_id"], r["pos"]) not in budgeted)
    assert {round(r["eps_s"], 9) for r in rows if r["doc_id"] == 0} == {1.085} and {r["eps_s"] for r in rows if r["doc_id"] == 1} == {100.0}
    said = {r["doc_id"]: r for r in api.shown(api.perturb_chosen(items, vocab, PrivacyConfig(), chosen)).collect()}
    assert said[0]["marked_original_text"].startswith("@@@4|alpha@@@ @@@5|beta@@@ gamma") and "@@@" not in said[1]["marked_perturbed_text"]
    first = api.perturb_chosen(items, vocab, PrivacyConfig(first_epsilon=True), chosen).where("doc_id = 0 AND eps IS NOT NULL").collect()
    assert {round(r["eps_eff"], 9) for r in first} == {1.085}


@pytest.mark.parametrize("high", [False, True])
def test_gumbel_draws_as_the_exponential_mechanism(spark, high):
    """Chi-square of 20,000 draws in the row against the probabilities of the relational form; rank 6 on is never drawn."""
    rows = [(i, f"c{i}", s) for i, s in enumerate([0.95, 0.9, 0.6, 0.55, 0.1, 0.05, 0.01], 1)]
    listed = spark.createDataFrame([("w", *r) for r in rows], "query string, rank int, cand string, score double").where("rank <= 5")
    probs = perturb.exponential(perturb.reversed_scores(perturb.normalised(listed, ["query"]), ["query"], F.lit(high)), ["query"], F.lit(3.0))
    want = {r["cand"]: r["prob"] for r in probs.collect()}
    near = F.array(*[F.struct(F.lit(c).alias("cand"), F.lit(s).alias("score")) for _, c, s in rows])
    drawn = spark.range(20_000).select(perturb.drawn_in_row(near, F.lit(5), F.lit(high), F.lit(3.0), 42, F.col("id"), F.lit(0)).alias("c"))
    got = {r["c"]: r["count"] for r in drawn.groupBy("c").count().collect()}
    assert set(got) == set(want)
    assert sum((got[c] - 20_000 * p) ** 2 / (20_000 * p) for c, p in want.items()) < 18.5  # 4 degrees, 0.001


def test_norms_equal_the_relational_form(spark):
    for scores in ([0.9, 0.5, 0.1], [0.4, 0.4, 0.4], [0.7]):
        listed = spark.createDataFrame([("w", i, f"c{i}", s) for i, s in enumerate(scores, 1)], "query string, rank int, cand string, score double")
        near = F.array(*[F.struct(F.lit(f"c{i}").alias("cand"), F.lit(s).alias("score")) for i, s in enumerate(scores, 1)])
        for high in (False, True):
            want = {r["cand"]: r["norm"] for r in perturb.reversed_scores(perturb.normalised(listed, ["query"]), ["query"], F.lit(high)).collect()}
            got = spark.range(1).select(perturb.norms(near, F.lit(9), F.lit(high)).alias("n")).first()["n"]
            assert {x["cand"]: pytest.approx(x["norm"]) for x in got} == want
    assert spark.range(1).select(perturb.drawn_in_row(F.array().cast("array<struct<cand:string,score:double>>"), F.lit(5), F.lit(False), F.lit(1.0), 1).alias("c")).first()["c"] is None


def test_no_candidate_rows_are_shuffled(spark):
    """Tokens and lists meet by one join; nothing is generated or windowed for candidates."""
    items, vocab = small(spark)
    tokens = risk.exploded(risk.in_row(detect.detect(items), PrivacyConfig()))
    plan = perturb.perturb(tokens, vocab, PrivacyConfig())._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_budgets_in_the_row(spark, tmp_path):
    """The same rows as the form with windows, without an exchange, and the same on a stream."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    found = detect.detect(docs)
    keys = ("doc_id", "pos", "token", "level", "eps", "eps_eff", "high")
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.select(*keys, "eps_s").collect())
    for config in (PrivacyConfig(), PrivacyConfig(first_epsilon=True), PrivacyConfig(ablation_2=True)):
        assert key(risk.exploded(risk.in_row(found, config))) == key(risk.budgets(risk.token_rows(found), config))
    rows = risk.in_row(found, PrivacyConfig())
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = risk.in_row(detect.detect(stream), PrivacyConfig()).writeStream.format("memory").queryName("budgets_stream").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert key(risk.exploded(spark.table("budgets_stream"))) == key(risk.exploded(rows))


@pytest.mark.parametrize("block", [16_384, 40])
def test_radius_join(spark, block):
    """All vectors within a radius and no other, most of them never compared where vectors lie in clusters."""
    rng_ = np.random.default_rng(5)
    centres = rng_.normal(0, 10, (12, 6))
    rows = [(i, [float(x) for x in centres[i % 12] + rng_.normal(0, 0.4, 6)]) for i in range(360)]
    vocab = spark.createDataFrame([*rows, (999, None)], "cand long, vec array<double>")
    queries = vocab.select(F.col("cand").alias("query"), "vec", F.when(F.col("cand") % 5 == 0, 0.0).when(F.col("cand") % 5 == 1, 40.0).otherwise(1.1).alias("radius"))
    got = {r["query"]: r for r in knn.within(queries, vocab, 16, block).collect()}
    m = np.array([v for _, v in rows])
    apart = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    assert set(got) == set(range(360))
    for i, r in got.items():
        radius = 0.0 if i % 5 == 0 else 40.0 if i % 5 == 1 else 1.1
        assert [x["cand"] for x in r["near"]] == [j for j in np.lexsort((np.arange(360), apart[i])) if apart[i, j] < radius]
    few = [r["compared"] for i, r in got.items() if i % 5 > 1]
    assert sum(few) < 0.2 * len(few) * 360
    assert knn.within(queries, vocab.where("false"), 16, block).agg(F.sum(F.size("near"))).first()[0] == 0


def test_adjacent_lists(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").limit(120)
    words, vocab = e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec"), F.lit(1.3).alias("radius")), e.select(F.col("vec_id").alias("cand"), F.col("embedding").alias("vec"))
    lists = mechanisms.adjacent_lists(words, vocab, 8.0).select("query", F.explode("near").alias("x")).select("query", "x.cand", F.round("x.prob", 9).alias("p"))
    want = mechanisms.adjacent(words.select("query", "radius"), knn.nearest_sql(words, vocab, 120, "euclid"), 8.0, ["query"]).select("query", "cand", F.round("prob", 9).alias("p"))
    assert sorted(map(tuple, lists.collect())) == sorted(map(tuple, want.collect()))


def test_running_sums(spark):
    rows = [(i * 7919 % 1000, i % 3, i % 11) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, g long, x long").repartition(3)
    total = Counter()
    for k, g, x in sorted(rows):
        total[None] += x
        total[g] += x
        total[k, "all"], total[k, "own"] = total[None], total[g]
    assert all(r["s"] == total[r["k"], "all"] for r in corpus.running(df, ["k"], {"s": F.col("x")}).collect())
    assert all(r["s"] == total[r["k"], "own"] for r in corpus.running(df, ["k"], {"s": F.col("x")}, ["g"]).collect())
    assert sorted(r["number"] for r in corpus.numbered(df.withColumn("k", F.lit(1)), ["k"]).collect()) == list(range(1000))
    assert corpus.running(df.where("false"), ["k"], {"s": F.col("x")}).collect() == []


def test_one_document_holds_most_words(spark):
    """Sub-blocks of a hot document find what all its pairs hold, whatever their size."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.when(F.col("vec_id") % 4 < 3, 1).otherwise(F.col("label") + 10).alias("doc_id"), F.col("vec_id").alias("word_id"), F.col("embedding").alias("vec"))
    noisy = e.withColumn("vec", F.transform("vec", lambda x, i: x.cast("double") + 0.3 * (rng.uniform(1, F.col("word_id"), i) - 0.5))).where("doc_id <> 13")
    rows = lambda n: sorted(tuple(r) for r in attacks.personal_match(e, noisy, 0.7, n).collect())
    a, b = ({d: [(r["word_id"], np.array(r["vec"], float)) for r in df.where(F.col("doc_id") == d).collect()] for d in (1, 10, 13)} for df in (e, noisy))
    got = rows(50)
    assert got == rows(5000)
    for d in (1, 10, 13):
        want = sum(any(float(x @ y) >= 0.7 for _, y in b[d]) for _, x in a[d])
        assert [r[1:3] for r in got if r[0] == d] == [(want, len(a[d]))] or not a[d]


def test_levels_of_odd_spans(spark, monkeypatch):
    """Empty spans give no level and spans end with the text, in chunks of any size; private characters are blanks."""
    given = ["é7 \U0001d538b", "", f"{OPEN}xthe{SHUT} 9", "Thé the 12345", None]
    entity = lambda a, b, source="x": (a, b, "", "PERSON", 1.0, source)
    rows = [(i, t, [entity(1, 1), entity(3, 99)] if i in (0, 3) else []) for i, t in enumerate(given)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, entities {detect.ENTITIES}")
    for size in (1, 1 << 20):
        monkeypatch.setattr(levels, "CHUNK", size)
        got = {r["doc_id"]: r for r in levels.levelled(docs, [("the", 2), ("thé", None)]).collect()}
        assert [got[i]["levels"] for i in range(5)] == [".3.55", "", "..222..3", "0005222555555", ""]
        assert [(t["token"], t["start"], t["end"], t["level"]) for t in got[0]["levelled"]] == [("é7", 0, 2, 3), ("\U0001d538b", 3, 5, 5)]
        assert [(t["token"], t["level"]) for t in got[2]["levelled"]] == [("xthe", 2), ("9", 3)]


def test_matches_are_counted_off():
    texts = pa.array([None, "", "ab", f"é{OPEN}\U0001d538x{SHUT}{OPEN}y{SHUT}", f"{OPEN}é{SHUT} "]).slice(1)
    size, row, start, end, match = counted(texts)
    assert (size.tolist(), row.tolist(), start.tolist(), end.tolist()) == ([0, 2, 4, 3], [2, 2, 3], [1, 3, 0], [3, 4, 1])
    assert match.to_pylist() == ["\U0001d538x", "y", "é"]
    assert [len(x) for x in counted(pa.array([], pa.string()))] == [0] * 5
