"""op5 against a scan of all diagonals."""

import math
from collections import Counter

import numpy as np
import pytest

from weftline.llm import decontaminate


def scan(doc: list, item: list, min_score: int = 12, min_share: float = 0.6):
    """The best score of an item along any diagonal, or None if none is a leak."""
    n, best = len(item), None
    at = {}
    for i, w in enumerate(doc):
        at.setdefault(w, []).append(i)
    for d, same in Counter(i - j for j, w in enumerate(item) for i in at.get(w, ())).items():
        run = score = 0
        for j, w in enumerate(item):
            run = max(0, run) + (1 if 0 <= j + d < len(doc) and doc[j + d] == w else -1)
            score = max(score, run)
        if same >= n - n // 5 if n < 9 else score >= min(min_score, math.ceil(min_share * n)):
            best = max(best or 0, score)
    return best


def changed(rng, item, pattern):
    out = list(item)
    n = len(item)
    kind, x = pattern
    if kind == "each":
        at = range(int(rng.integers(x)), n, x)
    elif kind == "some":
        at = rng.choice(n, min(n, x), replace=False)
    elif kind == "share":
        at = np.flatnonzero(rng.random(n) < x)
    else:  # cut at either end
        return out[x:] if rng.random() < 0.5 else out[:-x]
    for i in at:
        out[i] = f"z{rng.integers(10**6)}"
    return out


PATTERNS = [("some", 0), ("some", 1), ("some", 2), ("some", 3), ("each", 3), ("each", 4), ("each", 5), ("each", 7), ("share", 0.1), ("share", 0.2), ("share", 0.3), ("cut", 1), ("cut", 3)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    words = [f"v{i}" for i in range(300)]
    items, docs = [], []
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 20, 24, 40, 60):
        for _ in range(3):
            items.append([f"i{len(items)}x{w}" if rng.random() < 0.5 else w for w in rng.choice(words, n)])
    for pattern in PATTERNS:
        for item in items:
            for _ in range(2):
                own = changed(rng, item, pattern)
                docs.append((pattern, [*rng.choice(words, rng.integers(0, 30)), *own, *rng.choice(words, rng.integers(0, 30))]))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = spark.createDataFrame([(i, " ".join(w)) for i, (_, w) in enumerate(docs)], "doc_id long, text string")
    want = {(i, j): s for i, (_, w) in enumerate(docs) for j, item in enumerate(items) if (s := scan(w, item)) is not None}
    return items, docs, bench, rows, want


@pytest.mark.parametrize("limit", [10**6, 0])  # broadcast, and shuffled joins
def test_recall_by_pattern(planted, limit):
    items, docs, bench, rows, want = planted
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(rows, bench, broadcast_rows=limit).collect()}
    assert set(got) <= set(want)
    short = {k for k in want if len(items[k[1]]) < decontaminate.LONG}
    assert {k: got.get(k) for k in short} == {k: want[k] for k in short}  # complete under 14 tokens
    for pattern in PATTERNS:
        own = {k for k in want if docs[k[0]][0] == pattern}
        found = len(own & set(got)) / len(own)
        assert found >= (0.97 if pattern[0] == "share" and pattern[1] > 0.2 else 1.0), (pattern, found)
    assert sum(got[k] == want[k] for k in got) >= 0.99 * len(got)


def test_ties_repeats_and_short_items(spark):
    w = [f"t{i}" for i in range(40)]
    item = " ".join(w[:16])
    docs = spark.createDataFrame([(1, f"{item} x {item}", 7), (1, f"{item} x {item}", 7), (2, "one two three four", None), (None, item, 1), (3, None, 1), (4, "one two six four", 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(5, item), (5, item), (5, " ".join(w[20:36])), (6, "ONE two three four"), (7, ""), (None, item)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["score"], r["doc_from"]) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(1, 5, 16, 0), (2, 6, 4, 0)]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 3, 4]
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0
