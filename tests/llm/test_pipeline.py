import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from weftline.llm import mergedropout, neardup
from weftline.llm._spark import table, written

SF = "/root/testdata/sf0.001"


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", _lower(t))


def _lines(docs):
    key = lambda x: _lower(x.strip(" \t\n\x0b\f\r"))
    held = defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    return {i: "\n".join(x for x in t.split("\n") if len(held[key(x)]) < 3 or i == max(held[key(x)])) for i, t in docs.items()}


def _near(docs):
    sets = {}
    for i, t in docs.items():
        w = _words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * (n := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in docs.items() if find(i) == i}


def _leaks(text, items):
    at = defaultdict(list)
    doc = _words(text)
    for i, w in enumerate(doc):
        at[w].append(i)
    for item in items:
        need = min(12, math.ceil(0.6 * len(item)))
        for d, n in Counter(i - j for j, w in enumerate(item) for i in at[w]).items():
            run = best = 0
            for j, w in enumerate(item if n >= need else []):
                run = max(0, run + (1 if 0 <= j + d < len(doc) and doc[j + d] == w else -1))
                best = max(best, run)
            if best >= need:
                return True
    return False


def test_pipeline_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    items = [_words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = written(stages[0](spark, docs, SF))
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    want = _near(_lines({r["doc_id"]: r["text"] for r in kept.collect()}))
    want = {i: t for i, t in want.items() if not _leaks(t, items)}
    out = corpus_pipeline.run(spark, SF)
    got = {r["doc_id"]: r["text"] for r in mergedropout.decode(out, corpus_pipeline.MODEL_FILE).collect()}
    assert got == want


def test_odd_rows_pass_every_stage(spark):
    text = "Dies ist ein Satz von etwas mehr als zwanzig Zeichen, und er ist lang genug. "
    schema = "doc_id long, text string, lang string, source string, n_chars long, item_id int, key string"
    rows = [(None, text * 3, "de", None, None, 1, None), (1, None, None, None, None, None, "a"), (2, "", "de", "s", 0, 1, "b"), (3, "12345 !!", "en", "s", 8, 1, ""), (4, text * 4, "de", "s", 1, 2, "c"), (4, text * 4, "de", "s", 1, 2, "c"), (5, text * 4, None, "t", 1, None, None), (6, text * 400, "de", "t", 1, 0, "d")]
    docs = spark.createDataFrame(rows, schema)
    for df in (docs, docs.where("false")):
        now = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = written(stage(spark, now, SF))
            assert now.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, now, SF)
        ids = sorted((r["doc_id"] or 0) for r in out.collect())
        assert ids == ([] if df is not docs else [0, 4, 4])
        assert out.where("not lossless").count() == 0


def _shingles(t, size):
    w = _words(t)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def _alike(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_by_kind(spark):
    """Copies by how many of their five-word shingles they share: all at 0.8 or more are caught, none below it is."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    by = defaultdict(list)
    two = {i: _shingles(t, 2) for i, t in docs.items()}
    for i in sorted(docs):
        for s in two[i]:
            by[s].append(i)
    pairs = Counter()
    for own in by.values():
        if len(own) <= 30:  # shingles of few documents: near copies share many of these
            pairs.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    five = {i: _shingles(docs[i], 5) for pair in pairs for i in pair}
    kinds = defaultdict(list)
    for a, b in pairs:
        x = _alike(five[a], five[b])
        if x >= 0.3 or _alike(two[a], two[b]) >= 0.6:
            kinds["exact" if docs[a] == docs[b] else "near" if x >= 0.8 else "below"].append((a, b))
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 5, 80).collect()}
    joined = {kind: sum(found[a] == found[b] for a, b in own) for kind, own in kinds.items()}
    assert len(kinds["exact"]) >= 5 and len(kinds["near"]) >= 5 and len(kinds["below"]) >= 5, {k: len(v) for k, v in kinds.items()}
    assert joined["exact"] == len(kinds["exact"]) and joined["near"] == len(kinds["near"])
    chained = sum(1 for a, b in kinds["below"] if found[a] == found[b])  # only through others that are near both
    assert chained <= 0.2 * len(kinds["below"])
    print({k: len(v) for k, v in kinds.items()}, joined)
