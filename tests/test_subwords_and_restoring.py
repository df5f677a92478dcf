"""Subword tokens, restoring in expressions, and the survey of a session, each against a plain version."""

import json
import random
import re
import time
from datetime import datetime, timedelta

from lumenveil.functions.tokens import joined
from lumenveil.operators import restore, wordpiece
from lumenveil.streaming import live
from pyspark.sql import functions as F

STOP = {"the", "and", "for"}


def plain_pieces(word, vocab):
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
        if end is None:
            return None
        out.append((("##" if at else "") + word[at:end], at, end))
        at = end
    return out if len(word) <= 100 else None


def plain_encode(text, vocab):
    out = []
    for m in re.finditer(r"[一-鿿]|(?:(?![一-鿿])[^\W_])+|_|[^\w\s]", text or ""):
        word = m.group().lower() if len(m.group().lower()) == len(m.group()) else m.group()
        pieces = plain_pieces(word, vocab)
        if pieces is None:
            out.append(("[UNK]", m.group(), m.start(), m.end()))
        else:
            out += [(p, m.group()[a:b], m.start() + a, m.start() + b) for p, a, b in pieces]
    return out


def test_subwords(spark):
    rnd = random.Random(3)
    letters = "abcdé"
    vocab = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 4))) for _ in range(60)} | {"北", ".", "#", "##", "_", "x1", "##1"}
    vocab |= {"##" + "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 3))) for _ in range(60)}
    texts = [" ".join("".join(rnd.choice(letters + "AB") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(0, 15))) for _ in range(60)]
    texts += [None, "", " \t\n", "北京 北a北", "a.b#c_d x1", "İab", "😀ab😀", "a" * 101, "a" * 100, "##ab # ##", texts[0], "ab " * 3000]
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [(0, texts[1], "same id"), (None, texts[2], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    got = {(r["doc_id"], r["text"], r["pieces"]): [tuple(t) for t in r["encoded"]] for r in wordpiece.encode(docs, spark.createDataFrame([(v,) for v in vocab] + [("a",), ("a",)], "piece string")).collect()}
    assert len(got) == len(rows)
    for row in rows:
        assert got[row] == plain_encode(row[1], vocab | {"a"}), row[1]
    empty = wordpiece.encode(docs.limit(3), spark.createDataFrame([], "piece string")).collect()
    assert {t["token"] for r in empty for t in r["encoded"]} <= {"[UNK]"}
    assert wordpiece.encode(docs.limit(0), spark.createDataFrame([("a",)], "piece string")).count() == 0


def test_subwords_join_again(spark):
    docs = spark.createDataFrame([(1, "unwanted words")], "doc_id long, text string")
    vocab = spark.createDataFrame([(p,) for p in ("un", "##want", "##ed", "word", "##s")], "piece string")
    row = wordpiece.encode(docs, vocab).select(joined(F.transform("encoded", lambda t: t["token"])).alias("t")).first()
    assert row["t"] == "unwanted words"


def plain_restore(response, changes):
    """What restoring is to do, change by change."""
    if not response:
        return response
    for c in sorted(changes, key=lambda c: (-len(c["perturbed"]), c["index"])):
        if c["regex_pattern"] and re.search(c["regex_pattern"], response, re.I):
            response = re.sub(c["regex_pattern"], lambda _: c["original"], response, flags=re.I)  # noqa: B023
        elif c["perturbed"] and c["perturbed"] in response:
            response = response.replace(c["perturbed"], c["original"])
        else:
            for s in c["sub_changes"]:
                old = s["perturbed"]
                if len(old) < 2 or old.lower() in restore.R.SHORT_STOP or (old.isascii() and old.isalpha() and len(old) < 4):
                    continue
                if old.isascii() and old.isalnum():
                    response = re.sub(rf"\b{old}\b", lambda _: s["original"], response, flags=re.I)  # noqa: B023
                else:
                    response = response.replace(old, s["original"])
    return response


def test_restore_equals_plain(spark):
    rnd = random.Random(5)
    olds = ["Ann", "Lee", "a$1", "c:\\x", "Zoë", "50%", "the", "ÉCOLE", "x", "(y)", "1.5"]
    news = ["Kit", "Moore", "$0", "\\b", "Ärger", "the", "of", "go", "7777", "[z]", "Straße", "Boston"]
    tokens, said = [], []
    for doc in range(80):
        words = [rnd.choice(["so", "we", "met"] + olds) for _ in range(rnd.randint(1, 12))]
        new = [rnd.choice(news) if w in olds and rnd.random() < 0.8 else w for w in words]
        tokens += [(doc, i, w, n) for i, (w, n) in enumerate(zip(words, new, strict=True))]
        shown = [w if rnd.random() < 0.9 else "and" for w in new]
        said.append((doc, rnd.choice([" ", "  ", ", "]).join(w.upper() if rnd.random() < 0.2 else w for w in shown)))
    said += [(1000, "nothing changed"), (1001, None), (1002, "")]
    tokens += [(1002, 0, "Ann", "Kit")]
    groups = restore.change_groups(spark.createDataFrame(tokens, "doc_id long, pos int, token string, new_token string"))
    changes = {}
    for r in groups.collect():
        changes.setdefault(r["doc_id"], []).append(r.asDict(recursive=True))
    got = {r["doc_id"]: r["restored"] for r in restore.restore(spark.createDataFrame(said, "doc_id long, response string"), groups).collect()}
    assert len(got) == len(said)
    for doc, text in said:
        assert got[doc] == plain_restore(text, changes.get(doc, [])), (text, changes.get(doc))


def test_survey_amends_the_last_row(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda m: (t0 + timedelta(minutes=m)).isoformat()
    batches = [
        [("a", at(0), "a0", None), ("a", at(5), "a5", None), ("b", at(1), "b1", None), ("c", at(2), "c2", None), ("d", at(3), None, "alone"), (None, at(3), "x", None)],
        [("a", at(6), None, "good"), ("a", at(7), None, "again"), ("b", at(0), None, "its clock is slow"), ("b", at(2), "b2", None)],
        [("z", at(120), "z", None)],
        [("z", at(121), "z2", None)],
        [("c", at(122), None, "too late")],
    ]
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("session", "at", "entry", "survey"), r, strict=True))) for r in rows))
        time.sleep(0.05)
    steps = spark.readStream.schema("session string, at timestamp, entry string, survey string").option("maxFilesPerTrigger", 1).json(str(source))
    q = live.amended(steps).writeStream.format("memory").queryName("amended_log").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r["session"], r["entry"] or "", r["survey"] or "") for r in spark.table("amended_log").collect())
    assert got == [("a", "", "again"), ("a", "a0", ""), ("a", "a5", "good"), ("b", "b1", "its clock is slow"), ("b", "b2", ""), ("c", "", "too late"), ("c", "c2", ""), ("d", "", "alone"), ("z", "z", "")]


def test_subwords_of_a_text_of_many_different_words(spark):
    """40000 different words in one text: a search through the text's words for each would be 800 million steps."""
    words = ["".join("abcdefghij"[int(c)] for c in str(n)) for n in range(100_000, 140_000)]
    vocab = spark.createDataFrame([(p,) for p in "abcdefghij"] + [(f"##{p}",) for p in "abcdefghi"], "piece string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "Ab xj")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["encoded"] for r in wordpiece.encode(docs, vocab).collect()}
    plain = [t for w in words for t in (["[UNK]"] if "j" in w[1:] else [w[0], *[f"##{c}" for c in w[1:]]])]
    assert [t["token"] for t in got[1]] == plain
    assert [tuple(t) for t in got[2]] == [("a", "A", 0, 1), ("##b", "b", 1, 2), ("[UNK]", "xj", 3, 5)]
    assert time.time() - began < 90
