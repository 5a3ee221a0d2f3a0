"""Context trees, base scores and Kneser-Ney models against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from weftline.llm import ctw, langid
from weftline.llm._text import raw


def _log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class PlainTree:
    """Counts of every bit decision under every context, and the weighted probability by its definition."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for t in texts:
            held = bytes(depth) + t.encode() + b"\xff"
            for i in range(depth, len(held)):
                self.see(held[i - depth : i], held[i])

    def bits(self, symbol):
        return [(1 << b | symbol >> (8 - b), symbol >> (7 - b) & 1) for b in range(8)]

    def see(self, context, symbol):
        for node, bit in self.bits(symbol):
            for d in range(self.depth + 1):
                self.counts[context[self.depth - d :], node][bit] += 1

    def weighted(self, context, node):
        own = _log_kt(*self.counts.get((context, node), (0, 0)))
        if len(context) == self.depth:
            return own
        below = [self.weighted(c, node) for c in {c for c, n in self.counts if n == node and len(c) == len(context) + 1 and c[1:] == context}]
        return np.logaddexp(own, sum(below)) - math.log(2) if below else own

    def log10(self, context, symbol):
        total = 0.0
        for node, bit in self.bits(symbol):
            before = self.weighted(b"", node)
            for d in range(self.depth + 1):
                self.counts[context[self.depth - d :], node][bit] += 1
            total += (self.weighted(b"", node) - before) / math.log(10)
            for d in range(self.depth + 1):
                self.counts[context[self.depth - d :], node][bit] -= 1
        return total


def test_tree_is_the_definition():
    texts, depth = ["abracadabra", "banana band", ""], 2
    plain = PlainTree(texts, depth)
    data, offsets = raw(pa.array(texts))
    codes, _ = ctw.gram_codes(data, offsets, depth)
    tree = ctw.Tree([np.unique(codes & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True) for d in range(depth + 1)])
    some = np.unique(codes)[::3]
    want = [plain.log10(bytes([int(c) >> 16 & 255, int(c) >> 8 & 255]), int(c) & 255) for c in some]
    assert np.allclose(tree.slow(some), want, rtol=2e-5)


def test_base_score_and_counts(spark):
    texts = ["The cat, the CAT\tsat.", None, "", "the end of Äa", "unseen words only here", "the the the the", "cat"] * 3
    df = spark.createDataFrame([(i * 7 - 9, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    rows = [(i * 7 - 9, tokens(t)) for i, t in enumerate(texts)]
    c = Counter(w for i, t in rows if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in ctw.report(df).collect()}
    assert any(map(out, got)) and len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r["score"] < 0 and math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / (len((df.where(f"doc_id = {i}").first()["text"] or "").encode()) + 1) if i < 10 else r["bits_per_byte"])


def _plain_kn(texts):
    """log P of each 4-gram's last symbol: interpolated, absolute discounts by order, continuation counts below the top."""
    grams = Counter()
    for t in texts:
        sym = [ord(ch) if ch.isalpha() else 0 for ch in re.sub(r"[^a-z]+", " ", t)]
        if sym and sym[0] == 0:
            sym = sym[1:]
        held = [0, 0, 0, *sym]
        for i in range(3, len(held)):
            grams[tuple(held[i - 3 : i + 1])] += 1
    levels = {4: dict(grams)}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def prob(gram):
        k = len(gram)
        if k == 0:
            return 1 / 65536
        n = levels[k]
        once, twice = sum(x == 1 for x in n.values()), sum(x == 2 for x in n.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        own = {g: x for g, x in n.items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return prob(gram[1:])
        return max(n.get(gram, 0) - d, 0) / total + d * len(own) / total * prob(gram[1:])

    return grams, prob


def test_kneser_ney_is_the_definition():
    texts = ["the cat sat on the mat and the rat ran", "a cat and a rat", "then that"]
    grams, prob = _plain_kn(texts)
    data, offsets = raw(pa.array(texts))
    codes = langid.grams(*langid.symbols(data, offsets))
    keys, n = np.unique(codes, return_counts=True)
    told = {tuple(int(c) >> 16 * b & 0xFFFF for b in (3, 2, 1, 0)): x for c, x in zip(keys, n)}
    assert told == grams
    model = langid.Model({"en": (keys, n)})
    asked = [*grams, (0, 0, 0, ord("q")), (ord("t"), ord("h"), ord("e"), ord("z")), (ord("z"),) * 4, (ord("x"), ord("t"), ord("h"), ord("e"))]
    code = np.array([sum(s << 16 * (3 - i) for i, s in enumerate(g)) for g in asked], np.uint64)
    assert np.allclose(model.log_probs(code)[:, 0], [math.log(prob(g)) for g in asked], rtol=1e-4)


def test_many_languages_keep_what_each_has_seen():
    draw = np.random.default_rng(8)
    texts = {f"l{k:02d}": ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"[k % 20 : k % 20 + 5] + " "), 80)) for _ in range(3)] for k in range(60)}
    counts, plain = {}, {}
    for lang, own in texts.items():
        plain[lang] = _plain_kn(own)[1]
        counts[lang] = np.unique(langid.grams(*langid.symbols(*raw(pa.array(own)))), return_counts=True)
    model = langid.Model(counts)
    asked = np.concatenate([c[0][:3] for c in counts.values()])
    got = model.log_probs(asked)
    for j, lang in enumerate(model.languages):
        want = [math.log(plain[lang](tuple(int(c) >> 16 * b & 0xFFFF for b in (3, 2, 1, 0)))) for c in asked]
        assert np.allclose(got[:, j], want, rtol=1e-4)
    cells = sum(len(t.value) for t in (*model.tables.values(), *model.contexts.values()))
    assert cells <= 9 * sum(len(c[0]) for c in counts.values())  # not each gram for each language
    data, offsets = raw(pa.array([*(t[0] for t in texts.values()), "", "12"]))
    n, mean, _ = langid._measure(model, data, offsets)
    assert (n[-2:] == 0).all() and (mean[-2:] == 0).all()
    best = [model.languages[j] for j in mean[:-2].argmin(1)]
    assert sum(a == b for a, b in zip(best, texts)) >= 55


def test_measures_do_not_depend_on_how_many_cells_are_held(monkeypatch):
    texts = ["the cat sat", "", "a rat and the mat", "1 2", "x" * 500]
    data, offsets = raw(pa.array(texts))
    model = langid.Model({"a": np.unique(langid.grams(*langid.symbols(data, offsets)), return_counts=True)})
    whole = langid._measure(model, data, offsets)
    monkeypatch.setattr(langid, "CELLS", 7)
    assert all(np.allclose(a, b) for a, b in zip(whole, langid._measure(model, data, offsets)))
