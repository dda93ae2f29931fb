import numpy as np

from millrace.llm import classifier as cl


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = cl.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_held_out_labels_are_not_learnt(spark, docs):
    labels = docs.select("doc_id").selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    flipped = labels.withColumn("held", cl.held_out()).selectExpr("doc_id", "IF(held, 1 - quality, quality) AS quality")
    a, b = (sorted(map(tuple, cl.classify(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_shapes():
    assert [cl.shape(w) for w in ("Hello", "WORLD!!", "a1b22", "***")] == ["Aa", "A!!", "a0a0", "***"]


def test_odd_empty_and_no_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 0), (6, 0, 1), (8, None, 0), (None, 1, 0), (9, 7, 0)], "doc_id long, quality int, toxic int")
    assert cl.classify(odd, labels).count() == odd.count()
    assert cl.classify(none, labels).collect() == []
    assert {r["score"] for r in cl.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_votes_like_brute_force(spark, docs):
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS INT) AS quality")
    model = cl.fit(docs, labels)
    want = {}
    for r in docs.collect():
        x = cl.weighted(cl.terms(r["text"])[None].astype(np.float64), model.idf) @ model.axes
        x = x[0] / max(np.linalg.norm(x[0]), 1e-9)
        near = sorted(((float(np.dot(x, v)), k) for k, v in enumerate(model.vectors)), reverse=True)
        votes = [(max(s, 0) ** cl.POWER, model.labels[k]) for s, k in near[: cl.NEIGHBOURS]]
        total = sum(w for w, _ in votes)
        # Where a neighbour is as near as the last one, either may vote.
        tie = len(near) > cl.NEIGHBOURS and abs(near[cl.NEIGHBOURS - 1][0] - near[cl.NEIGHBOURS][0]) < 1e-6
        want[r["doc_id"]] = None if tie else sum(w * y for w, y in votes) / total if total > 1e-9 else model.prior
    got = {r["doc_id"]: r["score"] for r in cl.classify(docs, labels).collect()}
    assert set(got) == set(want)
    checked = [i for i, w in want.items() if w is not None]
    assert len(checked) > 0.8 * len(want) and all(abs(got[i] - want[i]) < 1e-4 for i in checked)


def test_axes_are_the_leading_ones(docs):
    counts = np.stack([cl.terms(r["text"]) for r in docs.collect()]).astype(np.float64)
    model = cl.NeighbourVote(counts, np.arange(len(counts)) % 2, dimensions=8)
    exact = np.linalg.svd(cl.weighted(counts, model.idf), full_matrices=False)[2][:8]
    assert np.linalg.svd(exact @ model.axes)[1].min() > 0.99


def test_repeated_doc_ids_do_not_make_the_sample_depend_on_order(spark):
    rows = [(1, "Good words are here."), (1, "other text &&& ***"), (3, "more good words"), (4, "bad $$$ ###"), (None, "x")]
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 1), (4, 0), (4, 0)], "doc_id long, quality int")
    a, b = (sorted((str(r["doc_id"]), round(r["score"], 6)) for r in cl.classify(spark.createDataFrame(t, "doc_id long, text string").repartition(n), labels).collect()) for t, n in ((rows, 1), (rows[::-1], 4)))
    assert a == b and len(a) == 5


def test_long_words_have_whole_shapes():
    assert cl.shape("a-" * 100) == "a-" * 100
