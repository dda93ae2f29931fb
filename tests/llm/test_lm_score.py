import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import lm_score as lm


def brute_tree(texts, depth):
    """Context-tree weighting by recursion over all contexts that occur; returns the probability of a byte."""
    counts = defaultdict(Counter)
    for t in texts:
        data = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                counts[data[i - d : i]][data[i]] += 1

    def pair(context, bits):
        ones = sum(n for x, n in counts[context].items() if f"{x:08b}".startswith(bits + "1"))
        return sum(n for x, n in counts[context].items() if f"{x:08b}".startswith(bits)) - ones, ones

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def children(context):
        return [c for c in list(counts) if len(c) == len(context) + 1 and c[1:] == context]

    def weighted(context, bits):
        own = kt(*pair(context, bits))
        if len(context) == depth:
            return own
        return np.logaddexp(own, sum(weighted(c, bits) for c in children(context))) - math.log(2)

    def bit(path, bits):
        """P(1) along the contexts of ``path``, from the root on."""
        z, o = pair(path[0], bits)
        own = (o + 0.5) / (z + o + 1)
        if len(path) == 1 or sum(pair(path[1], bits)) == 0:
            return own
        share = math.exp(kt(z, o) - math.log(2) - weighted(path[0], bits))
        return share * own + (1 - share) * bit(path[1:], bits)

    def probability(context, symbol):
        path = [context[len(context) - d :] for d in range(depth + 1)]
        path = [p for p in path if p in counts]
        total = 0.0
        for k in range(8):
            one = bit(path, f"{symbol:08b}"[:k])
            total += math.log10(one if f"{symbol:08b}"[k] == "1" else 1 - one)
        return total

    return probability


def counted(texts, depth, unseen=()):
    """Grams in order with their counts, those of ``unseen`` texts with none."""
    gram, n = zip(*[(g, np.full(len(g), k)) for k, some in ((1, texts), (0, unseen)) if some for g in [lm._grams(list(some), depth)[0]]], strict=True)
    return lm._summed(np.concatenate(gram), np.concatenate(n))


def local(texts, depth, unseen=()):
    """log10 probability by gram, from the whole tree in one piece."""
    gram, n = counted(texts, depth, unseen)
    levels = lm.tree_levels(gram, n, 0, depth)
    return dict(zip(gram.tolist(), lm.gram_scores(gram, levels[-1], lm.descend(levels, lm.weigh(levels)[1], None)).tolist(), strict=True))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_tree_like_recursion(depth):
    texts, unseen = [b"abab", b"aab ba", b"", b"ba"], [b"ab", b"aabb", b"", b"zb a"]
    tree, want = local(texts, depth, unseen), brute_tree(texts, depth)
    for text in unseen:
        data = b"\xff" * depth + text + b"\xff"
        for i in range(depth, len(data)):
            assert tree[int.from_bytes(data[i - depth : i + 1], "big")] == pytest.approx(want(data[i - depth : i], data[i]), abs=1e-9)


def test_probabilities_sum_to_one():
    texts = [b"the cat", b"the dog", b"a cat"]
    alike = local(texts, 3, [b"the", *(b"the" + bytes([x]) for x in range(255))])
    assert sum(10 ** p for g, p in alike.items() if g >> 8 == int.from_bytes(b"the", "big")) == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("depth,chunk", [(1, 300_000), (3, 50), (5, 2000)])
def test_subtrees_give_the_tree_in_one_piece(spark, monkeypatch, depth, chunk):
    monkeypatch.setattr(lm._subtrees, "__defaults__", (chunk,))
    texts = [f"Some text {k} of {k * k} words, {'abc' * (k % 4)} é ".encode().lower() * (1 + k % 3) for k in range(40)]
    gram, n = counted(texts[:30], depth, texts[30:])
    rows = spark.createDataFrame([(int(g), int(k)) for g, k in zip(gram, n, strict=True)], "gram long, n long").repartition(3)
    got = {r["gram"]: r["p"] for r in lm.gram_probabilities(rows, depth).collect()}
    assert got == pytest.approx(local(texts[:30], depth, texts[30:]), abs=1e-5)


def test_table_finds_its_grams_and_no_others():
    rng = np.random.default_rng(3)
    gram = np.unique(rng.integers(0, 1 << 40, 5000))
    table = lm.GramTable(gram[::2], np.arange(len(gram[::2]), dtype=np.float32) + 1)
    p, missing = table.look_up(gram)
    assert p[::2].tolist() == list(range(1, len(gram[::2]) + 1)) and missing.tolist() == list(range(1, len(gram), 2)) and not p[1::2].any()
    assert lm.GramTable(gram[:0], np.zeros(0, np.float32)).look_up(gram)[1].tolist() == list(range(len(gram)))


@pytest.mark.parametrize("frequent", [1, 1 << 10, 1 << 40])
def test_scores_are_sums_over_all_grams(docs, frequent):
    texts = {r["doc_id"]: (lm.lower_bytes(r["text"]), zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in docs.collect()}
    tree = local([t for t, held in texts.values() if not held], 3, [t for t, held in texts.values() if held])
    for r in lm.score(docs, depth=3, frequent=frequent).collect():
        assert r["score"] == pytest.approx(sum(tree[g] for g in lm._grams([texts[r["doc_id"]][0]], 3)[0].tolist()), rel=1e-5)


def check_base(table, **options):
    rows = table.collect()
    counts, total, n = Counter(), 0, 0
    for r in rows:
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            words = (r["text"] or "").encode().lower().split()
            counts.update(words)
            total, n = total + len(words) + 1, n + 1
    v = len(counts) + (n > 0)
    want = {}
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (total + v + 1)) for w in words) + math.log10((n + 1) / (total + v + 1))
        want[r["doc_id"]] = (len(words) + 1, sum(counts[w] > 0 for w in words) + (n > 0), base)
    got = lm.score(table, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2] and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][2], rel=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    return got


@pytest.mark.parametrize("share", [1 << 19, 50])
def test_base_like_brute_force(docs, odd, share):
    got = check_base(docs, share=share)
    held = [r for r in got if r["held_out"]]
    assert 0 < len(held) < len(got) and np.mean([r["bits_per_byte"] for r in held]) < 4
    check_base(odd, share=share)


def test_empty_table(none):
    assert lm.score(none).collect() == []
