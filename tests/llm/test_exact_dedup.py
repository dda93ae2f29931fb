import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup as ed


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 64}, {"block_bytes": 100, "fingerprint": lambda b: F.crc32(b) % 3}])
def test_like_brute_force(docs, odd, options):
    for table in (docs, odd):
        got = sorted(map(tuple, ed.exact_dedup(table, **options).collect()), key=str)
        assert got == brute(table.collect())


def test_empty_table(none):
    assert ed.exact_dedup(none).collect() == []


@pytest.mark.parametrize("bound", [0, 1000])
def test_dropping_keeps_columns_and_one_of_each(docs, bound):
    out = ed.drop_copies(docs, bound)
    assert out.columns == docs.columns
    assert out.count() == docs.select("text").distinct().count()
