import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import exact_dedup, ngram_join, quality_rules


def test_stages_take_effect_and_each_works_on_what_the_last_one_kept(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, held, d).collect(), docs.schema)
        assert out.columns == columns
        if name == "quality rules":
            assert {r[0] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in quality_rules.quality_rules(held).filter("kept").collect()}
        elif name == "exact dedup":
            assert {r[0] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in exact_dedup.exact_dedup(held).filter("kept").collect()}
        elif name == "n-gram Jaccard join":
            assert {r[0] for r in out.select("doc_id").collect()} == {r["class_id"] for r in ngram_join.similarity_classes(held).collect()}
        else:
            assert out.count() == held.count()
        held = out
    pieces = corpus_pipeline.run(spark, d)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in held.select("doc_id").collect()}


def test_verdicts_are_those_of_rows_where_doc_ids_are_null_or_repeated(spark):
    words = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    near = {k: w.replace(f"{k}59", "other") for k, w in words.items()}
    rows = [(1, words["a"], "s"), (None, words["a"], "s"), (None, words["b"], "s"), (None, words["c"], "t"), (None, words["c"], "s"), (7, words["d"], "s"), (7, words["e"], "s"), (8, words["d"], "s"), (9, words["f"], "t"), (9, words["f"], "s"), (5, None, "s"), (5, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for bound in (0, 1000):
        got = sorted(map(tuple, exact_dedup.drop_copies(docs, bound).collect()), key=str)
        assert len(got) == 7 and {r for r in got if r[1]} == {(1, words["a"], "s"), (None, words["b"], "s"), (None, words["c"], "s"), (8, words["d"], "s"), (7, words["e"], "s"), (9, words["f"], "s")}
    rows = [(1, words["a"], "s"), (None, near["a"], "s"), (None, words["b"], "s"), (None, near["b"], "s"), (None, words["c"], "s"), (4, words["d"], "s"), (7, near["d"], "s"), (7, words["e"], "s"), (7, near["e"], "s"), (9, words["f"], "t"), (9, words["f"], "s"), (None, "", "s"), (None, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for bound in (0, 1000):
        got = sorted(map(tuple, ngram_join.drop_near_copies(docs, bound).collect()), key=str)
        b, e = [r for r in got if r[1].startswith("b")], [r for r in got if r[1].startswith("e")]
        assert len(b) == len(e) == 1 and b[0][0] is None and e[0][0] == 7
        assert sorted((r for r in got if r not in b + e), key=str) == sorted([(1, words["a"], "s"), (None, words["c"], "s"), (4, words["d"], "s"), (9, words["f"], "s"), (None, "", "s"), (None, "", "s")], key=str)


#: Personal data that the fixture plants, and what stands in its place afterwards.
PLANTED = {"bob.smith@example.org": "[EMAIL]", "10.20.30.40": "[IP]", "4111 1111 1111 1111": "[CARD]", "+49 151 2345678": "[PHONE]", "DE89370400440532013000": "[IBAN]", "ssn 536-22-8145": "ssn [NATIONAL_ID]"}
FOOTER = "All rights reserved by the host of this page"


def fixture(seed):
    """Rows with good, bad, copied and nearly copied texts, a boilerplate line, personal data, null and repeated doc_ids."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(4, 9)))
    texts = []
    for k in range(40):
        lines = [" ".join(word() for _ in range(rnd.randint(15, 30))) for _ in range(5)]
        lines[k % 5] += " " + list(PLANTED)[k % len(PLANTED)] + " and"
        texts.append("\n".join([*lines, FOOTER]))
    texts += ["too short", "", None, "again and again " * 60, "\n".join([FOOTER] * 30 + ["x"])]
    texts += rnd.choices(texts[:40], k=12)  # copies
    texts += [t + " tail" for t in rnd.choices(texts[:40], k=12)]  # near copies
    long = " ".join(word() for _ in range(3000))
    texts += [long, long.replace(long.split()[7], "changed")]
    ids = [rnd.choice([None, *range(8), *range(100, 160)]) for _ in texts]
    return [(i, t, rnd.choice("hg"), len(t or "")) for i, t in zip(ids, texts, strict=True)]


def brute_quality(rows):
    texts, holders = defaultdict(set), defaultdict(set)
    norm = lambda line: " ".join(line.lower().split())
    for _, text, host, _ in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if norm(line):
                holders[host, norm(line)].add(text)
    common = {(h, line) for (h, line), t in holders.items() if len(t) > quality_rules.MIN_DOCS and len(t) > len(texts[h]) * quality_rules.SHARE}
    out = []
    for i, text, host, n in rows:
        words, lines = (text or "").split(), (text or "").split("\n")
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        stay = [x for x in lines if (host, norm(x)) not in common]
        gone = len(words) - sum(len(x.split()) for x in stay)
        if len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and gone < len(words) * quality_rules.DEPLETED:
            new = "\n".join(stay)
            out.append((i, new if gone else text, host, len(new) if gone else n))
    return out


def brute_near(rows):
    sets = []
    for _, text, _, _ in rows:
        w = text.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    groups = defaultdict(list)
    for r, row in zip(root, rows, strict=True):
        groups[r].append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).digest())) for g in groups.values()]


@pytest.mark.parametrize("seed", [1, 2])
def test_run_like_a_plain_pipeline(spark, tmp_path, seed):
    rows = fixture(seed)
    schema = "doc_id long, text string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    kept = brute_quality(rows)
    best = {}
    for r in kept:
        if r[1] not in best or (r[0] is not None and (best[r[1]][0] is None or r[0] > best[r[1]][0])):
            best[r[1]] = r
    near = brute_near(list(best.values()))
    assert len(rows) > len(kept) > len(best) > len(near) > 30
    want, library = Counter(), Tokenizer.from_file(corpus_pipeline.tokenizer_path("word_bpe_49k.json"))
    for i, text, _, _ in near:
        for plain, masked in PLANTED.items():
            text = text.replace(plain, masked)
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in filled.values():
        ends = [0, *(o + n for o, n in sorted(placed))]
        assert [o for o, _ in sorted(placed)] == ends[:-1] and ends[-1] <= 4096


def test_pipeline_over_odd_and_empty_tables(spark, tmp_path, odd, none):
    """Nulls in any column, ties and columns whose names clash with those of the stages."""
    for name, table in (("odd", odd), ("none", none)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        # The texts of 50 words or more repeat themselves, so the quality rules leave nothing.
        assert got == []
