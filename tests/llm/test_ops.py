import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import ctw, decontaminate, htmltext, langid, linededup, mergedropout, neardup, secrets, substrdedup, topk
from weftline.llm._text import raw

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "text string, doc_id long, lang string, _id long, key string"
W = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long_ = " ".join(W * 40)
    rows = [(None, 1, None, 0, "k"), ("", 2, "en", None, None), ("a b c", None, "en", 1, "x"), (long_, 3, "de", 1, "x"), (long_, 4, "de", 1, "x"), (long_, 4, "de", 1, "x"), ("x\n" + "Ä line of twenty or more signs\n" * 3, 5, None, 1, ""), ("Ä LINE of twenty or more signs ", 6, "fr", 1, ""), ("Ä line of twenty or more signs", 7, "fr", 1, "")]
    return spark.createDataFrame(rows, DOCS)


def test_odd_rows(spark, odd):
    none = odd.where("false")
    item = spark.createDataFrame([(1, " ".join(W[:30])), (None, "x"), (2, None), (3, "a b c d e")], "item_id long, text string")
    for df, n in ((odd, 9), (none, 0)):
        assert linededup.report(df).count() == n
        assert linededup.dedup_lines(df).columns == df.columns
        assert secrets.scan_secrets(df).count() == n
        assert langid.report(df).count() == n
        assert mergedropout.encode(df, MODEL).where("lossless").count() == n
        assert substrdedup.report(df).count() == n
        assert ctw.report(df).count() == n
    assert sorted(r["doc_id"] for r in decontaminate.leaks(odd, item).collect()) == [3, 4]
    assert decontaminate.leaks(none, item).count() == 0
    near = {r["doc_id"]: r for r in neardup.report(odd).collect()}
    assert len(near) == 7 and near[4]["component_id"] == 3 and near[1]["kept"] and near[2]["n_shingles"] == 0
    assert neardup.report(none).count() == 0
    lines = {r["doc_id"]: r for r in linededup.report(odd.where("doc_id > 4")).collect()}
    assert (lines[5]["n_dropped"], lines[6]["n_dropped"], lines[7]["n_dropped"]) == (3, 1, 0)


def test_topk_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(70)] + [(70, None), (71, [1.0, None, 0.0, 0.0]), (72, [float("nan")] * 4), (None, [1.0] * 4), (73, [1e12] * 4), (74, [0.5, 0.5])]
    rows += [(i, rows[5][1]) for i in range(80, 90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df.where("vec_id % 10 = 0"), df, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    for q, v in ok:
        if q % 10 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in ok if i != q and len(w) == len(v))[:7]
            assert sorted(got[q]) == [(n + 1, i, -x) for n, (x, i) in enumerate(s)]


@pytest.mark.parametrize("tile", [512, 2])  # 2: all larger groups take the way by rarest shingles
def test_near_duplicates_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = np.random.default_rng(2)
    texts = []
    for size in (1, 3, 6, 12, 14, 30, 90, 300):
        for _ in range(6):
            base = list(rng.choice(W, size))
            for edits in (0, 0, 1, 2, max(1, size // 20), size // 8):
                own = list(base)
                for _ in range(edits):
                    own[rng.integers(len(own))] = str(rng.choice(W))
                texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.report(df).collect()}
    sets = [{tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in range(len(sets))}


def test_near_duplicates_of_all_texts_of_a_repeated_id(spark):
    rng, rows = np.random.default_rng(5), []
    for k in range(60):
        base = list(rng.choice(W, rng.integers(1, 60)))
        for _ in range(3):
            own = list(base)
            if rng.random() < 0.5 and own:
                own[rng.integers(len(own))] = str(rng.choice(W))
            rows.append((int(rng.integers(0, 90)), " ".join(own) if rng.random() < 0.95 else ""))
    rows += [(rows[0][0], rows[0][1])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set() for w in (t.split() for _, t in rows)]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.report(df).collect()}
    assert got == {i: (max(len(s) for (j, _), s in zip(rows, sets) if j == i), find(i)) for i, _ in rows}
    assert sum(i == c for i, (_, c) in got.items()) < len(got) - 10


def test_substrings(spark):
    a, b = " ".join(W[:60]), " ".join(["x", *W[5:56], "y"])
    df = spark.createDataFrame([(1, a), (2, b), (3, " ".join(W[100:160]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substrdedup.without_repeats(df).collect()}
    assert got[1][0] == 0 and got[3][0] == 0 and got[2] == (51, "x y")


def test_leak_with_substitutions(spark):
    item = W[:24]
    held = W[200:240] + [w if i % 6 else "zz" for i, w in enumerate(item)] + W[240:280]
    df = spark.createDataFrame([(1, " ".join(held)), (2, " ".join(W[200:280])), (3, " ".join(W[:6] + W[300:360]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item).upper())], "item_id long, text string")
    for limit in (10**6, 0):
        assert [(r["doc_id"], r["item_id"], r["doc_from"]) for r in decontaminate.leaks(df, bench, broadcast_rows=limit).collect()] == [(1, 9, 41)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()) == [2, 3]


def test_encoding_is_plain_without_dropout_and_lossless_with():
    from sentencepiece import SentencePieceProcessor

    v, sp = mergedropout.Vocabulary(MODEL), SentencePieceProcessor(model_file=MODEL)
    texts = ["Hello  world\n x", "", " a", "日本語 é 😀", "ab" * 200, "   ", "tab\tend"]
    data, offsets = raw(pa.array(texts))
    ids, at = mergedropout.encode_texts(v, data, offsets, np.arange(len(texts)), dropout=0.0)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [sp.encode(t) for t in texts]
    texts.append("a literal ▁ sign")
    data, offsets = raw(pa.array(texts))
    for rate in (0.1, 0.7, 1.0):
        ids, at = mergedropout.encode_texts(v, data, offsets, np.arange(len(texts)), dropout=rate)
        assert [v.decode(ids[at[i] : at[i + 1]].tolist()) for i in range(len(texts))] == texts


def test_every_occurrence_is_dropped_on_its_own():
    v = mergedropout.Vocabulary(MODEL)
    text = " ".join(["nation", "internationalization", "of", "x" * 70] * 300)
    data, offsets = raw(pa.array([text, text]))
    docs = np.array([7, -3])
    ids, at = mergedropout.encode_texts(v, data, offsets, docs, 5, 0.1)
    forms, want = {}, []
    for doc in docs:
        place = 0
        for word in text.split(" "):
            sym = [v.space, *(int(v.first[ord(c)]) for c in word)]
            key = mergedropout.mix(mergedropout.mix(np.array([doc]).view(np.uint64) ^ np.uint64(mergedropout.mix_int(5))) + np.uint64(place))
            want += (got := mergedropout.agenda(v, sym, int(key[0]), np.uint64(int(0.1 * 2**64))))
            forms.setdefault(word, []).append(tuple(got))
            place += len(sym)
    assert ids.tolist() == want
    assert len(set(forms["internationalization"])) > 40
    assert all(len(set(forms[w])) > 1 for w in ("of", "nation"))


def test_ctw_is_a_distribution():
    texts = ["abracadabra " * 30, "banana " * 40]
    data, offsets = raw(pa.array(texts))
    codes, _ = ctw.gram_codes(data, offsets, 2)
    levels = [np.unique(codes & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True) for d in range(3)]
    tree = ctw.Tree(levels)
    context = np.uint64(ord("a") << 16 | ord("b") << 8)
    assert abs((10.0 ** tree.slow(context + np.arange(256, dtype=np.uint64))).sum() - 1) < 1e-6
    assert tree.log10(codes).sum() > 0.5 * len(codes) * math.log10(1 / 256)


def test_ctw_keeps_every_context(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(100)]  # 1.1 million contexts and symbols
    texts += ["abracadabra", "zz\x01é", ""]
    data, offsets = raw(pa.array(texts))
    codes, first = ctw.gram_codes(data, offsets)
    tree = ctw.Tree([np.unique(codes & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True) for d in range(ctw.DEPTH + 1)])
    want = np.add.reduceat(tree.log10(codes), first[:-1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for share in (2.0**-20, 2.0**-12):  # all grams broadcast; all but few joined
        monkeypatch.setattr(ctw, "HOT_GRAMS", share)
        got = {r["doc_id"]: r["score"] for r in ctw.score(df, df, min_count=1).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-5)


def test_language_on_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.report(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()
    assert zlib.crc32(b"3") % 4 == [r["r"] for r in spark.range(1).select(langid.remainder(langid.F.lit(3), 4).alias("r")).collect()][0]


def test_small_languages_reject(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(4)
    junk = [(10_000 + i, "".join(map(chr, rng.integers(0x4E00, 0x9000, 300))), None) for i in range(20)]
    junk += [(20_000, "zq xj " * 3, "stray")]
    both = df.unionByName(spark.createDataFrame(junk, df.schema))
    learned = langid.learn(both)
    assert set(learned[1]) == set(learned[0].languages) >= {"stray", "es"} and all(map(math.isfinite, sum(learned[1].values(), ())))
    got = langid.predict(both, learned).collect()
    assert not any(r["accepted"] for r in got if 10_000 <= r["doc_id"] < 20_000)
    assert sum(r["accepted"] for r in got if r["doc_id"] < 10_000) >= 0.97 * df.count()


def test_pages():
    page = """<html><body><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies, really.</div><article><h1>T &amp; U</h1>
    <p>One,  two.<br>Three.<aside>no</aside><p>Four <b>five</b>, six.</p><script>var x="</p>"</script></article><section id="comments"><p>I agree, of course, entirely.</p></section><footer>f</footer>"""
    assert htmltext.extract(page) == "T & U\nOne, two. Three.\nFour five, six."
    assert htmltext.extract(None) == htmltext.extract("") == ""


@pytest.mark.parametrize("box", ["article", "div"])
def test_paths_decide_inside_the_article(box):
    real = "This is a sentence of the text, and it has some length, as sentences of texts do; here it ends."
    page = f"""<html><body><nav><a href=x>Menu</a></nav><{box}><h1>T</h1><p>{real} 1</p><p>{real} 2</p><div class="qz7">Buy shoes now</div><p>{real} 3</p><h2>Part</h2>
    <ul class="xk"><li><a href=a>One more page</a></li><li><a href=b>Another page</a></li></ul><ul><li>short one</li><li>short two</li></ul>
    <div class="legal social"><p>{real} 4</p></div><div class="social">Tell all</div><p>{real} 5</p></{box}></body></html>"""
    assert htmltext.extract(page).split("\n") == ["T", f"{real} 1", f"{real} 2", f"{real} 3", "Part", "short one", "short two", f"{real} 4", f"{real} 5"]


def test_secrets():
    text = 'password = "abcdef1" and AKIA' + "B2" * 8 + "\nuser: bob key Xy7Zp0Qw9Lk2Mn4B at https://h.example/x"
    base = secrets.base_spans(text)
    assert [k for _, k, _ in base] == [0, 1]
    assert {3, 4, 5} <= {k for _, k, _ in secrets.linked_spans(text, base)}
    assert secrets.linked_spans("see https://h.example/x and Xy7Zp0Qw", []) == []


def test_long_secrets_are_linked():
    word = "Xy7Zp0Qw9Lk2Mn4B" * 12  # 192 characters
    text = f"user: bob\n{word} at https://h.example/x"
    spans = secrets.linked_spans(text, secrets.base_spans(text))
    assert (4, word) in {(k, text[a:b]) for a, k, b in spans}
