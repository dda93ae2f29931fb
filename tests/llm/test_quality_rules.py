import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import quality_rules as qr


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_like_brute_force(docs, odd):
    for table in (docs, odd):
        marked = table.withColumn("__gone", F.array().cast("array<int>"))
        for r in qr.text_stats(marked).join(table.select("doc_id", "text").distinct(), "doc_id").collect():
            assert tuple(r[n] for n in NAMES) == brute(r["text"])


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b c d", "a b", "", "x y z q x y z", "1 2 3 1 2 3 4 1 2 3"])
def test_slow_and_fast_windows_agree(spark, text, monkeypatch):
    df = spark.createDataFrame([(text.split(),)], "w array<string>")
    assert df.select(F.expr(qr.repeated_words("w"))).first()[0] == brute(text)[4]
    monkeypatch.setattr(qr, "_BITS", 2)  # too few bits for the places: the slow way
    assert df.select(F.expr(qr.repeated_words("w"))).first()[0] == brute(text)[4]


@pytest.fixture(scope="module")
def hosts(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"{body(i)}\nAll  RIGHTS reserved", "h") for i in range(40)] + [(100 + i, body(1000 + i), "h") for i in range(10)]
    rows += [(200, "\n".join(["all rights reserved"] * 60), "h"), (201, None, None), (202, body(0), "other")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("bound", [0, 1000])
def test_frequent_lines_go_and_depleted_documents_are_rejected(hosts, bound):
    got = {r["doc_id"]: r for r in qr.quality_rules(hosts, 20, 0.01, 0.7, bound).collect()}
    assert all(got[i]["removed_words"] == 3 and got[i]["kept"] for i in range(40))
    assert all(got[100 + i]["removed_words"] == 0 and got[100 + i]["kept"] for i in range(10))
    assert got[200]["removed_words"] == 180 and not got[200]["kept"] and not got[201]["kept"]
    out = qr.clean(hosts, 20, 0.01, 0.7, bound)
    assert out.columns == hosts.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(texts) == {i for i, r in got.items() if r["kept"]} and not any("RIGHTS" in t for t in texts.values())


def test_copies_of_one_text_count_once(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(i, text, "h") for i in range(100)], "doc_id long, text string, source string")
    assert all(r["kept"] for r in qr.quality_rules(df).collect())


def test_odd_and_empty_tables(odd, none):
    assert qr.quality_rules(odd).count() == odd.count()
    assert qr.quality_rules(none).collect() == [] and qr.clean(none).collect() == []
    assert qr.clean(odd).columns == odd.columns
