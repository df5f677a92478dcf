"""The privacy engine against small cases worked out by hand, plain restatements and properties."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenveil import api, resources as R
from lumenveil.config import PrivacyConfig
from lumenveil.functions import rng, scores
from lumenveil.functions.spans import find, mask
from lumenveil.functions.tokens import marked, ngrams, offsets, repaired, visual, words
from lumenveil.operators import attacks, corpus, detect, knn, leakage, mechanisms, perturb, restore, risk, utility
from lumenveil.sources import providers, readers, sinks
from lumenveil.streaming import live
from tests.test_draws_and_levels import small

SF = "/root/testdata/sf0.001"


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def one(spark, text, column):
    return texts(spark, text).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("pattern", [p for _, p in R.PATTERNS])
def test_spans_equal_finditer(spark, pattern):
    samples = ["", "a😀 13812345678, 4785380592391139 x", "12345 é12345 1234-5678-9012-3456 10.0.0.1 2024-01-02 12:30", "mail a.b@qq.com www.x.org/y $ 1,200.50 200 万元 京A12345", "电话１３８００１３８０００ 卡 ６２２２０２１２３４５６７８９０１ x１２３.４.５.６ 1380０138000", "7 " * 300 + "13812345678 " * 70, None]
    got = [[(s["start"], s["end"], s["text"]) for s in r["x"] or []] for r in texts(spark, *samples).select(find(F.coalesce("text", F.lit("")), detect.UNICODE + pattern).alias("x")).collect()]
    assert got == [[(m.start(), m.end(), m[0]) for m in re.finditer(pattern, s or "")] for s in samples]


def entities(spark, text):
    return [(e["start"], e["end"], e["entity_type"], round(e["confidence"], 2)) for e in one(spark, text, detect.chinese(F.col("text")))]


def test_sub_matches_win_by_confidence(spark):
    assert entities(spark, "4785380592391139") == [(0, 11, "QQ_NUMBER", 0.8), (11, 16, "QQ_NUMBER", 0.8)]
    assert entities(spark, "我在北京市") == [(2, 4, "GPE", 0.9)]
    assert ("PERSON", 1.0) in [(k, c) for _, _, k, c in entities(spark, "张伟先生你好")]
    assert entities(spark, "") == [] and entities(spark, "2024-01-02") == []


def test_disjoint_and_sorted(spark):
    rows = detect.explode(texts(spark, "张伟 13812345678 a@qq.com 4785380592391139 广州市 王者 200万元").select("doc_id", detect.chinese(F.col("text")).alias("entities"))).collect()
    spans = [(r["start"], r["end"]) for r in rows]
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_combined_first_counts(spark):
    span = lambda s, e, k, c: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit("x").alias("text"), F.lit(k).alias("entity_type"), F.lit(c).alias("confidence"), F.lit("t").alias("source")).cast(detect.ENTITY)
    got = one(spark, "x", detect.combined(F.array(span(0, 3, "A", 0.9), span(2, 4, "B", 0.9)), F.array(span(0, 3, "C", 0.9), span(1, 3, "D", 0.9), span(5, 6, "E", 0.4))))
    assert [e["entity_type"] for e in got] == ["A", "D"]


def test_rules_and_safe_words(spark):
    rows = texts(spark, "The secret, the code").select(detect.rule_hits(F.col("text"), [("the", 0), ("Secret", 5)]).alias("h"))
    hits = rows.first()["h"]
    assert [(h["start"], h["level"]) for h in hits] == [(0, 0), (12, 0), (4, 5)]


def test_mask(spark):
    assert one(spark, "call 13812345678  now", mask(F.col("text"), find(F.col("text"), r"\d{11}"))) == "call [UNK] now"
    nested = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("").alias("text")) for a, b in ((0, 6), (2, 4))])
    assert one(spark, "abcdefgh", mask(F.col("text"), nested)) == "[UNK]gh"
    assert one(spark, "abcdefgh", mask(F.col("text"), nested, leak_nested=True)) == "[UNK][UNK]efgh"


def test_budgets(spark):
    got = spark.range(1, 6).select(risk.budget(F.col("id"), PrivacyConfig()).alias("b")).collect()
    assert [r["b"] for r in got] == [8.0, 6.03, 4.05, 2.07, 0.1]
    toks = risk.budgets(risk.token_rows(detect.detect(texts(spark, "a@qq.com wrote the note; a, the", "the"))), PrivacyConfig()).collect()
    assert {r["eps_s"] for r in toks if r["doc_id"] == 1} == {100.0}
    assert all(0.1 <= r["eps"] <= 8 and r["eps_eff"] <= r["eps"] for r in toks if r["eps"] is not None)
    assert any(r["high"] for r in toks)


def test_neighbours_wanted(spark):
    eps = spark.createDataFrame([(8.0,), (6.03,), (4.05,), (2.07,), (0.1,)], "e double")
    assert [r[0] for r in eps.select(perturb.neighbours_wanted(F.col("e"), F.lit(False), PrivacyConfig())).collect()] == [28, 32, 39, 62, 1605]
    assert [r[0] for r in eps.select(perturb.neighbours_wanted(F.col("e"), F.lit(True), PrivacyConfig(chinese=True))).collect()] == [12, 12, 12, 12, 15]


def test_uniform_same_everywhere(spark):
    got = spark.range(1).select(rng.uniform(42, F.lit(7), F.lit(3), "risk").alias("u")).first()["u"]
    assert got == duckdb.connect().execute(f"SELECT {rng.uniform_sql('42', '7', '3', chr(39) + 'risk' + chr(39))}").fetchone()[0]
    assert math.isclose(got, 0.546011183945986)


def test_draws_follow_their_distribution(spark):
    u = rng.uniform(1, F.col("id"), "a")
    got = spark.range(20_000).select(rng.other_int(u, F.lit(5), 1, 10).alias("k"), rng.laplace(u, 2.0).alias("l")).collect()
    counts = [sum(r["k"] == i for r in got) for i in range(1, 11)]
    assert counts[4] == 0 and all(abs(c - 20_000 / 9) < 250 for i, c in enumerate(counts) if i != 4)
    assert abs(sum(abs(r["l"]) for r in got) / len(got) - 2) < 0.1


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
@pytest.mark.parametrize("block", [100_000, 60])
def test_knn_forms_agree(spark, metric, block):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").limit(150)
    q, v = e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("cand"), F.col("embedding").alias("vec"))
    key = lambda df: sorted((r["query"], r["rank"], r["cand"], round(r["score"], 6)) for r in df.collect())
    a, b = key(knn.nearest(q, v, 5, metric, block)), key(knn.nearest_sql(q, v, 5, metric))
    assert [x[:3] for x in a if metric == "cosine"] == [x[:3] for x in b if metric == "cosine"] and len(a) == len(b) == 750
    assert all(abs(x[3] - y[3]) < 1e-5 for x, y in zip(a, b))


def test_exponential_sums_to_one_and_reverses(spark):
    rows = spark.createDataFrame([("w", i, f"c{i}", s) for i, s in enumerate([0.9, 0.5, 0.1], 1)], "query string, rank int, cand string, score double")
    n = perturb.normalised(rows, ["query"])
    assert math.isclose(sum(r["prob"] for r in perturb.exponential(n, ["query"], F.lit(1.0)).collect()), 1)
    back = {r["cand"]: r["norm"] for r in perturb.reversed_scores(n, ["query"], F.lit(True)).collect()}
    assert back["c1"] == 0 and back["c3"] == 1
    flat = perturb.normalised(rows.withColumn("score", F.lit(1.0)), ["query"]).collect()
    assert all(math.isclose(r["norm"], 1 / 3) for r in flat)


def test_perturb_does_not_depend_on_partitions(spark):
    items, vocab = small(spark)
    got = []
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, perturb.assembled(api.perturb(items.repartition(int(n)), vocab)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and len(got[0]) == 30


def test_numbers_and_currencies(spark):
    rows = spark.createDataFrame([("5",), ("21st",), ("3.5",), ("$",), ("the",), ("word",), ("a1",)], "t string")
    got = {r["t"]: r for r in rows.select("t", perturb.route(F.col("t")).alias("r"), perturb.other_number(F.col("t"), F.lit(0.37)).alias("n"), perturb.other_currency(F.col("t"), F.lit(0.5)).alias("c")).collect()}
    assert [got[t]["r"] for t in ("5", "21st", "$", "the", "word", "a1")] == ["number", "number", "currency", "keep", "near", "keep"]
    assert got["5"]["n"] != "5" and re.fullmatch(r"\d+(st|nd|rd|th)", got["21st"]["n"]) and got["$"]["c"] != "$"
    z = rows.select(perturb.other_number_chinese(F.col("t"), F.lit(0.5), PrivacyConfig()).alias("z")).collect()
    assert z[0]["z"] != "5" and "." in z[2]["z"]


def test_mechanism_scale(spark):
    assert math.isclose(spark.range(1).select(mechanisms.noise_scale(F.lit(1.0), 1.0)).first()[0], 1.0)
    assert spark.range(1).select(mechanisms.noise_scale(F.lit(1.0), 8.0)).first()[0] < 0.11
    got = spark.createDataFrame([("12.5",), ("13.5",), ("nan",), ("word",)], "t string").select(mechanisms.shifted_number(F.col("t"), F.lit(0.0)).alias("x")).collect()
    assert [r["x"] for r in got] == ["12", "14", None, None]


def test_rates(spark):
    rows = spark.createDataFrame([(1, 0, "the", True), (1, 1, "word", True), (2, 0, "x", False), (2, 1, "y", True)], "doc_id long, pos int, token string, hit boolean")
    got = {r["doc_id"]: r for r in attacks.rates(rows).collect()}
    assert (got[1]["rate"], got[1]["rate_exp_stop"], got[1]["words"]) == (1.0, 0.5, ["the", "word"])
    run = {r["doc_id"]: r["rate"] for r in attacks.rates(rows, cumulative=True).collect()}
    assert run == {1: 1.0, 2: 0.75}


def test_leakage(spark):
    got = spark.createDataFrame([("a b c d", "a b c x"), ("a b", "a b"), (None, "x")], "a string, b string").select(leakage.ngram_leakage(F.col("a"), F.col("b")).alias("l")).collect()
    assert [r["l"] for r in got] == [0.5, 0.0, 0.0]


def test_scores():
    assert math.isclose(scores.bleu("the cat sat on the mat", "the cat sat on the mat"), 100) and scores.bleu("a", "b") == 0 == scores.bleu("", "b")
    assert scores.rouge("running dogs", "run dog") == pytest.approx((100, 100, 100))
    assert scores.ter("a b c", "a x c") == pytest.approx(100 / 3) and scores.ter("", "") == 0 and scores.ter("", "x") == 100
    for word, stem in {"caresses": "caress", "ponies": "poni", "relational": "relat", "conditional": "condit", "hopping": "hop", "falling": "fall", "adjustable": "adjust", "probate": "probat", "controlling": "control", "happy": "happi"}.items():
        assert scores.stem(word) == stem
    forms = ["{'summary': 'x y'}", '{"summary": "x y"}', '{"summary": "x y"} and more', "{summary: 'x y'}", "Summary: 'x y'", "none"]
    assert [scores.summary(f) for f in forms] == ["x y"] * 5 + [""]


def test_labels_and_f1(spark):
    got = spark.createDataFrame([('{"label": 3}',), ("{'label':1} {\"label\": 2}",), ("none",), (None,)], "r string").select(utility.label_of(F.col("r")).alias("l")).collect()
    assert [r["l"] for r in got] == [3, 1, 100, 100]
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 100)], "truth int, pred int")
    r = utility.classification(rows).first()
    assert math.isclose(r["accuracy"], 2 / 3) and math.isclose(r["weighted_f1"], 2 / 3) and (r["valid"], r["total"]) == (3, 4)
    assert utility.classification(rows.where("truth = 2")).first()["accuracy"] == 0


def test_tokens(spark):
    assert one(spark, "  a  b\n", words(F.col("text"))) == ["a", "b"]
    assert [t["text"] for t in one(spark, "don't, 5€", offsets(F.col("text")))] == ["don", "'", "t", ",", "5", "€"]
    assert one(spark, "a b a b a", ngrams(words(F.col("text")), 2)) == ["a b", "b a"]
    assert one(spark, "see http : / /x and www .site .com 你 好", repaired(F.col("text"))) == "see http://x and www.site.com 你好"
    toks = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(n).alias("level")) for t, n in (("Kit", 3), ("##ty", 5), ("ran", 0), (".", 0))])
    assert one(spark, "", marked(toks)) == "@@@5|Kitty@@@ ran."
    shown = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(t.replace("##", "")).alias("text"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("level")) for t, a, b, n in (("Kit", 0, 3, 1), ("##ty", 3, 5, 5), ("x", 6, 7, 0))])
    assert [(v["text"], v["token_indices"], v["level"]) for v in one(spark, "", visual(shown))] == [("Kitty", [0, 1], 5), ("x", [2], 0)]


def test_restore_round_trip(spark):
    toks = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([("Ann", "Bob"), ("Lee", "Roy"), ("met", "met"), ("Kit", "Zoe")])], "doc_id long, pos int, token string, new_token string")
    groups = restore.change_groups(toks)
    assert [(r["index"], r["original"], r["indices"]) for r in groups.orderBy("index").collect()] == [(0, "Ann Lee", [0, 1]), (3, "Kit", [3])]
    said = spark.createDataFrame([(1, "bob-roy met Zoe."), (2, "no changes"), (3, None)], "doc_id long, response string")
    assert {r["doc_id"]: r["restored"] for r in restore.restore(said, groups).collect()} == {1: "Ann Lee met Kit.", 2: "no changes", 3: None}


def test_corpus(spark):
    assert one(spark, ' "a\t\nb  c" ', corpus.cleaned(F.col("text"))) == "a b c"
    vocab = corpus.vocabulary(texts(spark, "a a a b b c d", "e"))
    assert {r["word"] for r in corpus.rare_words(vocab, 0.5).collect()} == {"c", "d", "e"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('label\ttext\n1\tsays "hi"\n2\tplain\n')
    assert [tuple(r) for r in readers.load(spark, "ag_news", str(tmp_path / "a.tsv")).collect()] == [('says "hi"', "1"), ("plain", "2")]
    (tmp_path / "b.json").write_text('[{"id": "1", "dialogue": "d", "summary": "s"}]')
    assert [tuple(r) for r in readers.load(spark, "samsum", str(tmp_path / "b.json")).collect()] == [("d", "s")]
    (tmp_path / "c.jsonl").write_text('{"username": "u", "comments": [{"text": "x"}, {"other": 1}, {"text": "y"}]}\nno json\n')
    users = readers.users(spark, str(tmp_path / "c.jsonl")).cache()
    flat = readers.comments(users)
    assert [r["text"] for r in flat.orderBy("comment_idx").collect()] == ["x", "y"]
    assert [c["text"] for c in readers.renested(flat).first()["comments"]] == ["x", "y"]
    assert [c["text"] for c in readers.rewritten(users, F.upper).first()["comments"]] == ["X", None, "Y"]
    (tmp_path / "g.txt").write_text("2 2\nb 1 2\na 3 4\nb 5 6\nlong 1 2 3\n")
    assert {r["cand"]: list(r["vec"]) for r in readers.vectors(spark, str(tmp_path / "g.txt"), 2).collect()} == {"a": [3.0, 4.0], "b": [1.0, 2.0]}
    assert readers.load(spark, "other", "") is None
    sinks.save(texts(spark, "x"), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


def test_providers(spark):
    def answer(batch):
        if "bad" in batch:
            raise RuntimeError
        return [t.upper() for t in batch]

    assert [r["response"] for r in providers.live(answer)(texts(spark, "a").coalesce(1)).collect()] == ["A"]
    assert [r["response"] for r in providers.live(answer)(texts(spark, "bad").coalesce(1)).collect()] == [providers.APOLOGY]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(str(tmp_path / "in"))
    q = live.masked(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("masked_stream").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("masked_stream").collect())) == sorted(map(tuple, live.masked(docs).collect()))


def test_perturb_draws_among_all_wanted(spark):
    """At a budget of 0.1 a draw is among 1605 neighbours, not the first 200."""
    rows = [("".join(chr(97 + i // 26**k % 26) for k in range(4)), [math.cos(i / 1000), math.sin(i / 1000)]) for i in range(2000)]
    vocab = spark.createDataFrame(rows, "cand string, vec array<double>")
    tokens = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(0).alias("pos"), F.lit(rows[0][0]).alias("token"), F.lit(3).alias("level"), F.lit(0.1).alias("eps_eff"), F.lit(False).alias("high"))
    place = {w: i for i, (w, _) in enumerate(rows)}
    got = [place[r["new_token"]] for r in perturb.perturb(tokens, vocab, PrivacyConfig()).collect()]
    assert 1400 < max(got) < 1605 and sum(i >= 200 for i in got) > 300
