import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from weftline.llm import runs
from weftline.llm._text import Words


def brute(w, least=12):
    """All runs by their definition: for each period the stretches in which words q apart are equal."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("pairs", [1 << 20, 37])
def test_runs_are_those_of_the_definition(monkeypatch, pairs):
    monkeypatch.setattr(runs, "PAIRS", pairs)
    draw = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(draw.randint(1, 4)):
            n, signs = draw.randint(0, 90), "abcdefghijklmnopqrst"[: draw.choice([1, 2, 3, 20])]
            w = [draw.choice(signs) for _ in range(n)]
            if n > 5 and draw.random() < 0.6:
                s, p = draw.randrange(n), draw.randint(1, 12)
                w = [w[i] if i < s else w[min(n - 1, s + (i - s) % p)] for i in range(n)]
            docs.append(w)
        least = draw.choice([12, 12, 12, 2, 3, 5, 8])
        texts = [" ".join(d) for d in docs]
        raw = "".join(texts).encode()
        words = Words(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        start, end, period = runs.text_runs(words, raw, least)
        for i, d in enumerate(docs):
            own = (start >= words.first[i]) & (start < words.first[i + 1])
            assert [tuple(map(int, x)) for x in zip(start[own] - words.first[i], (end - start)[own], period[own])] == brute(d, least)


def test_masked_words_are_in_no_run():
    w = "a b c d e f x a b c d e f y z z z z z z z".split()
    raw = " ".join(w).encode()
    low, high = runs.segments(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), 6)
    assert [(int(a), int(b)) for a, b in zip(low, high)] == [(0, 6), (7, 13), (14, 21)]


def test_report_against_brute_force(spark):
    draw = random.Random(2)
    rows = [(None, "a b " * 9), (3, None), (4, ""), (5, " \n\t "), (6, "x " * 40), (6, "x " * 40), (7, "Ä ä " * 12 + "end")]
    rows += [(i, " ".join(draw.choice(["one", "two", "three", "four"]) for _ in range(draw.randint(0, 120)))) for i in range(100, 220)]
    rows += [(1000, " ".join(f"w{i % 20011}" for i in range(60_000)))]
    df = spark.createDataFrame([(t, i, [1], "x") for i, t in rows], "text string, doc_id long, runs array<int>, collapsed string")
    got = sorted((tuple(r) for r in runs.report(df).collect()), key=str)
    want, changed = [], 0
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w, changed = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)], changed + 1
        found = brute(w) if n < 1000 else [(0, 60_000, 20_011)]
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        gone = {j for s, m, q in found for j in range(s + q, s + m)}
        told = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), n))
    assert got == sorted(want, key=str) and changed > 5
    assert runs.report(df.where("false")).count() == 0
    plain = {r["doc_id"]: r for r in runs.periodic_runs(df.where("doc_id = 7")).collect()}
    assert plain[7]["collapsed"] == "Ä ä end" and [tuple(r) for r in plain[7]["runs"]] == [(0, 24, 2)]
