"""Each corpus operator against a brute-force version, over whole small tables and rows at the edge."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import xxhash
from pyspark.sql import functions as F

from lumenveil.llm import chat, common, decontaminate, langid, linededup, neardup, packing, quality, queries, substring, tokencount, warc

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7919 % 3000}" for i in range(12_000))
#: Null, empty and blank texts, one word, repeated rows and ids, a long text, other white space, no letters.
EDGE = [None, "", " \n\t", "one", "same words " * 30, "same words " * 30, LONG, LONG + " more", "a\x0bb\x0cc d e", "1234 5678 !!", "<|endoftext|> x  \n  y   z ", "ﬁ Ａ ½ \x00 ▁▁ é😀"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1000 + i, t, "en" if i % 2 else None, "x", len(t or "")) for i, t in enumerate(EDGE)] + [(1004, EDGE[4], "en", "x", 0), (None, "no id here", "en", "x", 0)]
    # A column whose name an operator may use itself.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit("own")).withColumn("kept", F.lit(0)).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def words(text):
    return (text or "").encode().split()


def joined(items, similar):
    """Least index reachable for each index, by all pairs."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if find(i) != find(j) and similar(items[i], items[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(items))]


def test_words():
    for t in EDGE:
        assert [w.decode() for w in common.words_of(t)] == re.findall(common.WORD, t or "")


def test_word_hashes_part_words_as_words_of():
    import pyarrow as pa

    texts = [t for t in EDGE] + ["x" * 300_000, "a b"]
    hashes = [h.tolist() for (h,) in common.word_hashes(pa.array(texts, pa.string()))]
    of = {}
    for t, h in zip(texts, hashes, strict=True):
        ws = words(t)
        assert len(ws) == len(h)
        for w, x in zip(ws, h, strict=True):
            assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)
    assert [h.tolist() for (h,) in common.word_hashes(pa.array(texts, pa.string()).slice(3))] == hashes[3:]


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5200)]
    got = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a long, b long"), "test").collect()}
    ids = sorted({x for a, b in pairs if a != b for x in (a, b)})
    linked = {frozenset(p) for p in pairs}
    want = joined(ids, lambda x, y: frozenset((x, y)) in linked)
    assert got == {x: ids[w] for x, w in zip(ids, want, strict=True)}


def test_components_of_a_long_chain(spark, monkeypatch):
    """Rounds grow with the logarithm of a chain's length; edges that come later meet the roots known."""
    rounds, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: (rounds.append(name), write(df, name))[1])
    p = [int(x) for x in np.random.default_rng(1).permutation(20_000)]
    chain = list(zip(p, p[1:], strict=False))
    half = common.components(spark.createDataFrame(chain[::2], "a long, b long"), "chain")
    assert {r["id"]: r["root"] for r in half.collect()} == {x: min(e) for e in chain[::2] for x in e}
    whole = common.components(spark.createDataFrame(chain[1::2], "a long, b long"), "chain", half)
    assert [tuple(r) for r in whole.selectExpr("count(*)", "count(DISTINCT id)", "max(root)").collect()] == [(20_000, 20_000, 0)]
    assert sum(x == "chain-forest" for x in rounds) <= 16


def test_op1(docs, rows, nothing):
    count = Counter(tuple(w[i : i + 35]) for _, t in rows for w in [words(t)] for i in range(len(w) - 34))
    want = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    got = [tuple(r)[:4] for r in substring.without_repeats(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(x[2] for x in want) > 1000
    assert substring.without_repeats(nothing).count() == 0


def test_op2_statistics_and_verdict(spark, docs, rows, nothing):
    got = defaultdict(list)
    for r in quality.judge(docs, []).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    for d, t in rows:
        w = re.findall(common.WORD, t or "")
        three = Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(common.WORD, x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), failed, not failed)
        assert want in got[d]
    assert quality.judge(nothing, []).count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = quality.fit(many, labels)
    both = quality.judge(many, rules).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    table = {(r["quality"], r["kept"]): r["count"] for r in both}
    assert table.get((0, False), 0) > 0.9 * sum(n for (q, _), n in table.items() if q == 0)
    assert table.get((1, False), 0) <= 0.02 * sum(n for (q, _), n in table.items() if q == 1)
    assert quality.fit(nothing, labels) == [] and str(rules[0][0])


def test_op2_learner_grows_and_prunes():
    rows = [(i % 10 == 0, i % 3 == 0, 100.0, 5.0, 0.5 if i % 10 == 0 else 0.01, 0.0, 0.0, 0.3 if i % 20 == 0 else 0.0, 0.0, float(i % 7)) for i in range(300)]
    rules = quality.learn(rows)
    assert [[lit.feature for lit in r] for r in rules] == [["symbol_share"]]
    assert quality.learn([]) == [] and quality.learn([(False, False, *[1.0] * 8)] * 5) == []


def test_op3(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(0, 9000, 3)] + [(6, "http://h/6", "again"), (None, None, None)], "page_id long, url string, html string")
    bad = pages.where("coalesce(page_id, 0) <> 9").withColumn("html", F.when(F.col("page_id").isin(0, 4095, 6), "bad").otherwise(F.col("html"))).union(spark.createDataFrame([(8888, "u", "new")], pages.schema))
    got = {(r["page_id"], r["problem"]) for r in warc.audit(pages, bad).collect()}
    assert got == {(0, "damaged"), (6, "damaged"), (4095, "damaged"), (9, "lost"), (8888, "extra")}
    assert warc.audit(pages, pages.repartition(3)).count() == 0 and warc.audit(pages.where("false"), pages.where("false")).count() == 0
    placed = {r["page_id"]: r for r in warc.audit(pages, pages.where("coalesce(page_id, -1) not in (0, 3)")).collect()}
    assert placed[0]["offset"] == 0 and placed[3]["offset"] == placed[0]["length"]
    # Equal records of one id that change alike, one of several, and the number of equal ones.
    twice = spark.createDataFrame([(7, "u", "a"), (7, "u", "a"), (8, "u", "x"), (9, "u", "p"), (9, "u", "q"), (9, "u", "q"), (10, "u", "z")] + [(11, "u", f"r{i}") for i in range(300)], pages.schema)
    for was, now in ((7, "CORRUPT"), (9, "q"), (11, "r1")):
        other = twice.withColumn("html", F.when(F.col("page_id") == was, now).otherwise(F.col("html")))
        assert [(r["page_id"], r["problem"]) for r in warc.audit(twice, other).collect()] == [(was, "damaged")]
    assert {r["page_id"] for r in warc.audit(twice, twice.dropDuplicates()).collect()} == {7, 9}
    assert warc.audit(twice, twice.repartition(5)).count() == 0


def test_op4_forward_sums_all_segmentations():
    column = {"a": 0, "b": 1, "ab": 2, "ba": 3}
    prob = np.array([[0.3, 0.2, 0.4, 0.1, langid.UNKNOWN, 0.0]])

    def total(s):
        return 1.0 if not s else sum(prob[0][column[s[:n]]] * total(s[n:]) for n in (1, 2) if n <= len(s) and s[:n] in column)

    ws = ["a", "ab", "abba", "babab", "b" * 700]
    own = langid.Vocabulary(column)
    assert np.allclose(np.exp(langid.forward(ws, own, prob)[:4, 0]), [total(w) for w in ws[:4]])
    assert np.isclose(langid.forward(ws, own, prob)[4, 0], 700 * np.log(0.2))
    into = langid.expected(["abba", "b" * 700], np.array([0, 0]), np.array([2.0, 1.0]), own, prob)[0]
    assert np.isclose(into[:4] @ [1, 1, 2, 2], 8 + 700)


def test_op4_forward_over_the_whole_vocabulary(rows):
    """Real pieces of all lengths, unknown characters and long words against a plain sum; expected counts against its gradient."""
    column = langid.pieces_of(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    prob = rng.dirichlet(np.full(len(column), 0.5), 2) + 1e-9
    prob = np.hstack([prob, np.full((2, 1), langid.UNKNOWN)])
    own = langid.Vocabulary(column)
    pieces = list(column)
    long = [p for p in pieces if len(p) > 8]
    ws = [langid.MARK + "".join(rng.choice(long, 2)).replace(langid.MARK, "") for _ in range(60)] + ["".join(rng.choice(pieces, 4)) for _ in range(60)]
    ws += [langid.MARK + w.lower() for _, t in rows[:20] for w in (t or "").split()[:40]] + ["日本語のテキスト", "é😀\u0378x", "x" * 3000, ""]

    def logs(word, p):
        sums = [0.0] + [-np.inf] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - own.longest), e):
                k = column.get(word[s:e], len(column) if e - s == 1 else None)
                if k is not None:
                    sums[e] = np.logaddexp(sums[e], sums[s] + np.log(p[k]))
        return sums[-1]

    assert own.longest == max(map(len, column)) > 8
    got = langid.forward(ws[:-1], own, prob)
    assert np.allclose(got, [[logs(w, p) for p in prob] for w in ws[:-1]], rtol=1e-9, atol=1e-7)
    some = [w for w in ws[:-1] if w]
    langs = np.arange(len(some)) % 2
    into = langid.expected(some, langs, np.ones(len(some)), own, prob)
    assert np.isclose(into @ np.array([len(p) for p in pieces] + [1]), [sum(len(w) for w, x in zip(some, langs, strict=True) if x == y) for y in (0, 1)]).all()
    k = int(np.argmax(into[0][:-1]))
    more = prob.copy()
    more[0, k] *= 1 + 1e-6
    up = sum(logs(w, more[0]) - logs(w, prob[0]) for w, x in zip(some, langs, strict=True) if x == 0 and pieces[k] in w) / np.log1p(1e-6)
    assert np.isclose(up, into[0, k], rtol=1e-3)


def test_op4_held_out(spark, docs, nothing):
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(many.where(~langid.held_out()), P.path("piece_bpe_32k.model"), per_language=100, rounds=1)
    got = langid.predict(many.withColumn("held", langid.held_out()), model).where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.98
    edge = {r["doc_id"]: r for r in langid.predict(docs, model).where("doc_id >= 1000").collect()}
    assert [edge[1000 + i]["lang_pred"] == "und" for i in (0, 1, 2, 9)] == [True] * 4 and all(0 <= r["score"] <= 1 for r in edge.values())
    assert langid.predict(nothing, model).count() == 0
    assert langid.predict(docs.limit(3), langid.fit(nothing, P.path("piece_bpe_32k.model"))).select("lang_pred").distinct().first()[0] == "und"


def test_op5(spark, docs, rows, nothing):
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).select("doc_id", "text")
    occ = defaultdict(list)
    for r in plain.collect():
        for i, line in enumerate((r["text"] or "").split("\n")):
            if re.search(common.WORD, line):
                occ[line].append((r["doc_id"], i))
    lines = sorted(occ)
    sets = [frozenset(x[i : i + 12] for i in range(max(1, len(x) - 11))) for x in lines]
    near = lambda a, b: 80 * max(len(a), len(b)) <= 100 * min(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b)
    comp = defaultdict(list)
    for line, c in zip(lines, joined(sets, near), strict=True):
        comp[c] += occ[line]
    want = {x: min(v) for v in comp.values() for x in v if x != min(v)}
    got = {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"]) for r in linededup.surplus(plain).collect()}
    assert len(got) >= 0.98 * len(want) and all(want.get(k) == v for k, v in got.items())
    left = {r["doc_id"]: r for r in linededup.without_surplus(docs.where("doc_id is not null")).collect()}
    text = {d: t for d, t in rows}
    for d, r in left.items():
        assert r["text"] == (None if text[d] is None else "\n".join(x for i, x in enumerate(text[d].split("\n")) if (d, i) not in got))
    assert set(left[next(iter(left))].asDict()) == set(docs.columns) and linededup.surplus(nothing).count() == 0


def test_op6(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "B"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c"), (5, 5, None, None), (None, 0, "user", "z")]
    turns += [(9, i, "user", str(i)) for i in range(700)] + [(8, i, "user", str(i)) for i in range(699)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    assert sorted(r["conv_id"] if r["conv_id"] is not None else -1 for r in chat.maximal(df).collect()) == [-1, 2, 3, 5, 9]
    twins = spark.createDataFrame([(1, 0, "user", None), (2, 0, "user", ""), (3, 0, None, "a"), (4, 0, "unknown", "a"), (4, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    assert sorted(r["conv_id"] for r in chat.maximal(twins).collect()) == [1, 4]  # what renders alike is alike
    out = [r["rendered"] for r in chat.rendered(df).where("conv_id = 5").collect()]
    assert out == ["<|unknown|>\n\n"] and chat.rendered(df.where("false")).count() == 0


def test_op7(docs, rows, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = sorted(map(repr, (tuple(r) for r in tokencount.count_tokens(docs, P.path("piece_bpe_32k.model")).collect())))
    want = [(d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t in rows]
    assert got == sorted(map(repr, want)) and tokencount.count_tokens(nothing, P.path("piece_bpe_32k.model")).count() == 0
    counter = tokencount.PieceCounter(P.path("piece_bpe_32k.model"))
    for t in (" ", "  a", "a  b", "x" * 5000, "ab" * 3000, "日本語テキスト", "▁ ▁"):
        assert counter.count(t) == len(model.encode(t))


@pytest.mark.parametrize("width", [2, 5])
def test_op8(docs, rows, nothing, width):
    kept = [(d, neardup.shingles(t, width)) for d, t in rows if d is not None]
    kept.sort(key=lambda x: x[0])
    near = lambda a, b: bool(a) and bool(b) and 80 * max(len(a), len(b)) <= 100 * min(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b)
    want = [(d, len(s), kept[c][0]) for (d, s), c in zip(kept, joined([s for _, s in kept], near), strict=True)]
    out = neardup.near_duplicates(docs.where("doc_id is not null"), neardup.Join(width=width)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert neardup.near_duplicates(nothing).count() == 0
    left = [r["doc_id"] for r in neardup.without_copies(docs.where("doc_id is not null"), neardup.Join(width=width)).collect()]
    assert sorted(left) == sorted({c for _, n, c in want if n} | {d for d, n, _ in want if not n})


def test_op8_large_nodes_and_families(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(160):  # one family of copies with a few words changed each, and unrelated texts
        t = list(base)
        for k in rng.integers(0, 100, 3):
            t[k] = f"x{i}_{k}"
        texts.append(" ".join(t))
    texts += [" ".join(f"u{i}_{k}" for k in range(60)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [neardup.shingles(t, 2) for t in texts]
    want = joined(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, neardup.Join(tiny=3, small=10)).collect()}
    assert [got[i] for i in range(200)] == want


def test_op9(spark, nothing):
    rng = np.random.default_rng(1)
    vocab = [f"word{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [text(n) for n in (16, 24, 36, 55, 140)]
    para = items[2].split()
    del para[5], para[11]
    clean = [text(int(n)) for n in rng.integers(20, 600, 80)]
    leaky = [f"{text(100)} {items[0]} {text(50)}", f"{items[1].upper()} {text(30)}", f"{text(7)}\n{' '.join(para)}. {text(9)}", items[3], f"{text(300)} {items[4]}"]
    df = spark.createDataFrame(list(enumerate(clean + leaky)) + [(900, None), (901, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "too short")], "item_id long, text string")
    for config in (decontaminate.Retrieval(), decontaminate.Retrieval(block=2)):
        made = decontaminate.Decontaminator(df, bench, config)
        assert sorted((r["doc_id"], r["item_id"]) for r in made.leaks(df).collect()) == [(80 + i, i) for i in range(5)]
    assert sorted(r["doc_id"] for r in made.clean(df).collect()) == [*range(80), 900, 901]
    assert decontaminate.Decontaminator(nothing, bench.where("false")).leaks(nothing).count() == 0
    assert decontaminate.subsequence([b"a", b"b", b"c"], [b"x", b"a", b"c", b"b", b"c"]) == 3


def test_op9_by_latent_retrieval(spark):
    """The cosine search finds nine tenths of what counting words proves to be there, items with 28 % of other words included; a map
    without meaning finds next to none, and all clean texts stay clean."""
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    made = decontaminate.Decontaminator(docs, bench)
    rng = np.random.default_rng(4)
    texts = [r["text"] for r in docs.where("text is not null").orderBy("doc_id").limit(200).collect()]
    words = [w.decode() for t in texts for w in decontaminate.terms(t)]
    planted = []
    for _, text in made.blocks[0] * 6:
        said = [w.decode() for w in decontaminate.terms(text)]
        for i in rng.choice(len(said) * 4 // 5, int(0.28 * len(said)), replace=False):
            said[i] = words[int(rng.integers(len(words)))]
        base = texts[int(rng.integers(len(texts)))].split()
        at = int(rng.integers(len(base) + 1))
        planted.append(" ".join([*base[:at], *said, *base[at:]]))

    def ways(latent):
        index = decontaminate.Index(made.blocks[0], made.rare[0], latent, made.config)
        return [{x[0]: x[4] for x in index.search(lambda t=t: t, h)} for t, h in zip(planted, decontaminate.hashes(pa.array(planted)), strict=True)]

    own = [i for i, _ in made.blocks[0]] * 6
    real = ways(made.latent)
    blind = ways(np.zeros_like(made.latent))
    assert all(i in x for i, x in zip(own, real, strict=True))
    assert [set(x) for x in real] == [set(x) for x in blind]
    assert sum(x[i] == "latent" for i, x in zip(own, real, strict=True)) >= 0.9 * len(own)
    assert not any(way == "latent" for x in blind for way in x.values())


def test_op9_finds_every_verbatim_item(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    items = [(r["item_id"], b" ".join(decontaminate.terms(r["text"]))) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for t in [b" ".join(decontaminate.terms(r["text"]))] for i, x in items if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.Decontaminator(docs, bench).leaks(docs).collect()}
    assert want and want <= got and len(got) <= 1.1 * len(want)


def test_op10(docs, rows, nothing):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [(d, [*own.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows]
    out = [r.asDict() for r in packing.pack(docs, P.path("byte_bpe_50k.json"), block=64).collect()]
    want = Counter()
    for d, x in ids:
        for a in range(0, len(x), 2048):
            part = x[a : a + 2048]
            want[(d, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(x))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048 and len(v) <= 128
    assert packing.pack(nothing, P.path("byte_bpe_50k.json")).count() == 0


def test_op10_production_limits_bind(spark):
    """Each sequence of the query keeps all three limits, and some reach the one on loss."""
    bins = defaultdict(list)
    for r in queries.op10_packing(spark, SF).collect():
        bins[r["sequence_id"]].append((r["length"], r["length"] - (r["start"] == 0)))
    assert all(sum(n for n, _ in v) <= 2048 and len(v) <= 16 and sum(x for _, x in v) <= 2046 for v in bins.values())
    assert any(sum(x for _, x in v) == 2046 for v in bins.values()) and sum(n for v in bins.values() for n, _ in v) > 0.99 * 2048 * (len(bins) - 1)


def test_op10_limits_all_dimensions():
    demand = np.array([[100.0, 1, 90], [50, 1, 50], [30, 1, 0], [20, 1, 20], [10, 1, 10]] * 20)
    limits = np.array([200.0, 3, 120])
    where, offset = packing.place(demand, limits)
    for b in set(where):
        assert (demand[where == b].sum(axis=0) <= limits).all()
    assert len(set(where)) < 45


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    r = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert sorted(repr(tuple(x)) for x in df.select(*cols).collect()) == sorted(repr(tuple(x[names.index(k)] for k in cols)) for x in r.fetchall())


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    held = docs.where("doc_id is not null").drop("key", "kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in held.collect()}
        held = common.materialize(stage(spark, held, SF), "t")
        assert held.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert {r["doc_id"] for r in held.collect()} <= before
    ids = {r["doc_id"] for r in held.collect()}
    assert not ids & {1000, 1001, 1002, 1009} and len(ids) > 100
    packed = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert {r["doc_id"] for r in packed.collect()} == ids


def test_op5_shingles_of_whole_lines(spark):
    """Full character shingles of every position, against all pairs."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of strange herbs in the cellar tonight"
    cjk = "".join(chr(0x4E00 + i * 37 % 900) for i in range(120))
    lines = ["https://www.example.com/a", "https://www.other.org/zzz", "International cooperation", "International agreements", "name of row\t1\t2\t3 and more here", "name of row\t9\t8\t7 quite other", "short", "short", "shore"]
    lines += [base, base + "!", base.replace("quick", "quack"), "X" + base[1:], cjk, "中" + cjk[1:], cjk[:60] + cjk[:60][::-1], "é" * 10, "x" * 9000, "x" * 9000 + "y"]
    lines += ["".join(chr(97 + (i * i + i // 7) % 26) for i in range(5000)), "".join(chr(97 + (i * i + i // 7) % 26) for i in range(4999)) + "?"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    want = [frozenset(x[i : i + 12] for i in range(max(1, len(x) - 11))) for x in lines]
    hashed = [{xxhash.xxh64_intdigest(s.encode("utf-32-be"), 42) for s in x} for x in want]
    assert [{v % 2**64 for v in r["s"]} for r in df.orderBy("doc_id").select(linededup.shingle_set(F.col("text"), 12).alias("s")).collect()] == hashed
    own = defaultdict(set)
    for r in linededup.shingle_rows(df.select(F.col("doc_id").alias("h"), F.lit(0).alias("g"), F.col("text").alias("line")), 12).collect():
        own[r["h"]].add(r["x"] % 2**64)
    assert [own[i] for i in range(len(lines))] == hashed
    comp = joined(want, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    got = {r["doc_id"]: r["kept_doc_id"] for r in linededup.surplus(df).collect()}
    assert {i: c for i, c in enumerate(comp) if i != c} == got and {10, 12, 14} <= set(got) and not {1, 3, 5} & set(got)


def test_op5_compares_large_bands_in_full(spark):
    """Pairs alike among lines that share bands with many lines of their template, against all pairs."""
    rng = np.random.default_rng(3)
    some = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    template, lines = some(150), []
    for i in range(300):
        own = some(30)
        lines += [template + own] if i % 60 else [template + own, template + own[:-6] + some(6)]
    lines = [lines[i] for i in rng.permutation(len(lines))]
    comp = joined([frozenset(x[i : i + 12] for i in range(len(x) - 11)) for x in lines], lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    want = {i: c for i, c in enumerate(comp) if i != c}
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert len(want) == 5
    got = {r["doc_id"]: r["kept_doc_id"] for r in linededup.surplus(df).collect()}
    assert got == want
    for small in (3, 10**6):
        assert {r["doc_id"]: r["kept_doc_id"] for r in linededup.surplus(df, linededup.Lines(small=small)).collect()} == want


def test_op9_finds_short_and_changed_items(spark):
    """Verbatim items of 1 to 15 words, and items with up to 28 % of their words changed, each in the midst of other text."""
    rng = np.random.default_rng(11)
    vocab = [f"word{i}" for i in range(3000)]
    text = lambda n: list(rng.choice(vocab, n))
    items, texts = [], []
    for n in [1, 2, 3, 4, *[5, 8, 10, 12, 15, 24, 40, 60, 140] * 6]:
        item = [f"own{len(items)}", *text(n - 1)]
        said = list(item)
        if n >= 24:  # the last fifth, the answer, stays
            for i in rng.choice(n * 4 // 5, int(0.28 * n), replace=False):
                said[i] = f"other{i}"
        items.append(" ".join(item))
        texts.append(" ".join(text(int(rng.integers(0, 200))) + said + text(int(rng.integers(0, 200)))))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.Decontaminator(df, bench).leaks(df).collect()}
    assert got == {(i, i) for i in range(len(items))}


def test_op8_compares_what_the_last_level_leaves(spark):
    rng = np.random.default_rng(8)
    texts = []
    for i in range(60):  # one template, similarity under 0.8, and a few pairs alike
        own = [f"u{i}_{k}" for k in range(14)]
        texts.append(" ".join([f"b{k}" for k in range(100)] + own))
        if i % 10 == 0:
            texts.append(texts[-1] + f" more{i}")
    texts = [texts[i] for i in rng.permutation(len(texts))]
    want = joined([neardup.shingles(t, 2) for t in texts], lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, neardup.Join(trees=2, tiny=3, small=4, deepest=1)).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) == 60


def test_op8_recall_in_large_nodes(spark):
    """Pairs alike in one family whose nodes all hold far more than `small` sets, and which no other links join."""
    rng = np.random.default_rng(12)
    texts = []
    for i in range(250):  # any two share 100 of some 164 shingles
        texts.append(" ".join([f"b{k}" for k in range(101)] + [f"u{i}_{k}" for k in range(32)]))
        if i % 5 == 0:
            texts.append(texts[-1].replace(f"u{i}_3 ", "") + " " + " ".join(f"x{i}_{k}" for k in range(26)))
    texts = [texts[i] for i in rng.permutation(len(texts))]
    sets = [neardup.shingles(t, 2) for t in texts]
    want = joined(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    pairs = [i for i, w in enumerate(want) if w != i]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, neardup.Join(tiny=4, small=60)).collect()}
    assert len(pairs) == 50 and all(got[i] in (i, want[i]) for i in range(len(texts)))
    assert sum(got[i] == want[i] for i in pairs) >= 49


def test_op8_parity_bits_leave_out_no_link():
    import pyarrow as pa

    texts = [" ".join(f"w{i}" if i % 40 >= k else f"x{k}{i}" for i in range(n)) for n in (3, 40, 200, 3000) for k in range(6)]
    b = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts))), pa.array(range(len(texts)))], names=["text", "doc_id", "key"])
    (out,) = neardup.signer(neardup.Join())(iter([b]))
    bits = np.stack([out.column(x).to_numpy().view(np.uint64) for x in neardup.SKETCH[3:]], axis=1)
    sets = [neardup.shingles(t, 2) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert linked
    for i, j in linked:
        differ = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
        assert differ <= len(sets[i] ^ sets[j]) and 180 * differ <= 20 * (len(sets[i]) + len(sets[j]))


def test_op8_rival_families_in_one_node(spark):
    import random

    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    other = base[:30] + [f"v{i}" for i in range(30)]

    def changed(of):
        out = list(of)
        for at in r.sample(range(len(out)), r.choice([1, 2, 3])):
            out[at] = f"x{r.randrange(10**6)}"
        return " ".join(out)

    texts = [changed(base) for _ in range(260)] + [changed(other) for _ in range(60)]
    texts += [" ".join(base[:25] + [f"y{r.randrange(10**6)}" for _ in range(25)]) for _ in range(120)]
    want = joined([neardup.shingles(t, 2) for t in texts], lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df, neardup.Join(tiny=4, small=40)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_op5_near_copies_meet_few_others(spark, monkeypatch):
    """Lines near one text, around the threshold to each other, become one component before all pairs of other components are made."""
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    base, lines = letters(400), []
    for _ in range(240):
        line = list(base)
        for at in rng.integers(0, 400, 2):
            line[at] = letters(1)
        lines.append("".join(line))
    comp = joined([frozenset(x[i : i + 12] for i in range(len(x) - 11)) for x in lines], lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    met, pairs = [], linededup.met_in_prefixes
    monkeypatch.setattr(linededup, "met_in_prefixes", lambda posts, config: met.append(pairs(posts, config).count()) or pairs(posts, config))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["kept_doc_id"] for r in linededup.surplus(df, linededup.Lines(small=3)).collect()}
    assert len(got) > 100 and got == {i: c for i, c in enumerate(comp) if i != c}
    assert sum(met) < 240, met


def test_op8_large_nodes_are_parted_by_size(spark):
    """Sets whose sizes allow a link share a cell, whatever the sizes; sets two steps apart share none."""
    sizes = [*range(1, 400), *range(400, 40000, 97), 50000, 62500, 78125, 10**6, 1250000]
    df = spark.createDataFrame([(n,) for n in sizes], "n_set long")
    cells = {r[0]: set(r[1]) for r in df.select("n_set", neardup.size_cells(neardup.Join())).collect()}
    for n in sizes:
        for m in sizes:
            if n <= m and 80 * m <= 100 * n:
                assert cells[n] & cells[m], (n, m)
            elif m > 1.57 * n:
                assert not cells[n] & cells[m], (n, m)
    texts = [" ".join(f"w{i % 7} v{i}" for i in range(k)) for k in (30, 31, 60, 61, 120, 121, 240, 241)]
    docs = spark.createDataFrame([(i, texts[i % 8] + (" end" * (i // 8))) for i in range(80)], "doc_id long, text string")
    few = neardup.Join(small=3, tiny=2)
    sets = [neardup.shingles(r["text"], 2) for r in docs.orderBy("doc_id").collect()]
    want = joined(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    assert [r["component_id"] for r in neardup.near_duplicates(docs, few).orderBy("doc_id").collect()] == want
