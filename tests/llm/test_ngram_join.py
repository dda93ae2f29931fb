from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import ngram_join as nj
from millrace.llm.components import connected_components


def brute(rows, size=5, threshold=0.8):
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append(set(zip(*[w[k:] for k in range(size)], strict=False)) if len(w) >= size else {tuple(w)} if w else set())
    n = len(rows)
    links, root = Counter(), list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i in range(n):
        least[find(i)].append(rows[i]["doc_id"])
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((rows[i]["doc_id"], ids[find(i)], links[i]) for i in range(n)), key=str)


def near_groups(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(60)]
        for c in range(12):
            words = list(base)
            for at in rng.integers(0, 60, c % 4):
                words[at] = f"new{rng.integers(1e9)}"
            rows.append((len(rows), " ".join(words) + ("  " if c == 5 else "")))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("options", [{}, {"block_docs": 4, "bound": 0}, {"block_words": 300}])
def test_like_brute_force(spark, docs, odd, options):
    for table in (near_groups(spark), *((docs, odd) if not options else ())):
        got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in nj.similarity_classes(table, **options).collect()), key=str)
        assert got == brute(table.collect())


def test_pruning_drops_none_that_reach_the_threshold():
    rng = np.random.default_rng(1)
    for n in (8, 64, 128):
        m = nj.least_matches(n)
        assert 0 <= m <= 0.8 * n
    base = rng.integers(0, 1 << 32, (40, 128), dtype=np.uint32)
    other = base.copy()
    other[:, rng.permutation(128)[:20]] += 1
    alive = nj.unpruned(base, other)
    assert alive.diagonal().all() and alive.sum() == 40


def test_verification_ways_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(60)]
    all_pairs = ~np.eye(60, dtype=bool)
    exact = np.array([[i != j and len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (nj.linked(sets, all_pairs, 60, 0.5) == exact).all()
    assert (nj.linked(sets, all_pairs[:20, 20:], 20, 0.5) == exact[:20, 20:]).all()
    few = np.zeros((60, 60), dtype=bool)
    few[3, 4] = few[4, 3] = True
    assert (nj.linked(sets, few, 60, 0.5) == (exact & few)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (200, 200)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100, 200: 200}


def test_dropping_and_empty_table(spark, none):
    groups = near_groups(spark)
    out = nj.drop_near_copies(groups)
    assert out.columns == groups.columns and out.count() == len({c for _, c, _ in brute(groups.collect())})
    assert nj.similarity_classes(none).collect() == [] and nj.drop_near_copies(none).collect() == []
