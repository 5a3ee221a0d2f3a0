"""Secrets and pages against plain versions, and their odd rows."""

import hashlib
import re

import pytest

from weftline.llm import htmltext, secrets

SF = "/root/testdata/sf0.01"


def _base(text):
    """The three patterns as stated, nothing else."""
    out = [(m.start(), "assign", m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


def _linked(text, base, reach=200):
    """Every part against every other."""
    ids = [m.span() for m in secrets.IDENT.finditer(text)]
    ends = [m.span() for m in secrets.ENDPOINT.finditer(text)]
    taken = [(a, b) for a, _, b in base] + ids + ends
    weak = [m.span() for m in secrets.RANDOM.finditer(text) if secrets.looks_random(m[0]) and all(b <= m.start() or a >= m.end() for a, b in taken)]
    cuts = [m.start() for m in secrets.BLANK_LINE.finditer(text)]

    def near(x, others):
        for s, e in others:
            apart = e <= x[0] or s >= x[1]
            between = any(min(s, x[0]) < c <= max(s, x[0]) for c in cuts)
            if apart and max(s - x[1], x[0] - e) <= reach and not between:
                return True
        return False

    all_ids, all_secrets = [(a, b) for a, k, b in base if k == "access"] + ids, [(a, b) for a, k, b in base if k != "access"] + weak
    out = [(s, "ident", e) for s, e in ids if near((s, e), all_secrets)]
    out += [(s, "secret", e) for s, e in weak if near((s, e), all_ids) or near((s, e), ends)]
    return out + [(s, "endpoint", e) for s, e in ends if near((s, e), all_ids) and near((s, e), all_secrets)]


def _told(spans):
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda x: (x[0], secrets.KINDS.index(x[1]), x[2])))


def test_secrets_are_those_of_the_patterns(spark):
    key, token = "AKIA" + "Q7" * 9, "Xy7Zp0Qw9Lk2Mn4B"
    made = [None, "", "é" * 50 + f" Password = '{token}' AKIA12", f"{'ab12' * 7} token:abcde SECRET=abc.def api_key: x", "É" + "0f" * 12 + "g", f"user: bob\n{token * 200} https://h.example/x", f"user: bob\n\n{token}", f"login=al {'x ' * 120}{token}", f"{key}{key} apikey=secret=123456 passwd:passwd:abcdef", "İ token=ABCDEF ſecret=ABCDEF"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in secrets.scan_secrets(df).collect():
        base = _base(texts[r["doc_id"]])
        kinds = [k for _, k, _ in base]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds.count(k) for k in ("assign", "access", "hex")), texts[r["doc_id"]][:200]
        assert r["base_sha256"] == hashlib.sha256(_told(base).encode()).hexdigest()
        assert r["spans"] == _told(base + _linked(texts[r["doc_id"]], base)), texts[r["doc_id"]][:300]


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]


def test_ratios_find_the_text_by_themselves(pages, monkeypatch):
    want = [htmltext.extract(p) for p in pages]
    plain = [re.sub(r"(</?)(article|main)\b", r"\1div", p) for p in pages]
    assert [htmltext.extract(p) for p in plain] == want
    monkeypatch.setattr(htmltext, "BOILERPLATE_TAGS", frozenset())
    monkeypatch.setattr(htmltext, "BOILERPLATE_ROLES", frozenset())
    by_ratio = [htmltext.extract(p) for p in plain]
    assert sum(a == b for a, b in zip(by_ratio, want)) >= 0.94 * len(want)
    monkeypatch.setattr(htmltext, "_fused", lambda blocks, texts: [1.0] * len(blocks))
    without = [htmltext.extract(p) for p in plain]
    assert sum(a == b for a, b in zip(without, want)) < 0.4 * len(want)


def test_text_is_what_the_article_holds(pages):
    """The pages' articles, taken apart by plain patterns."""
    for page in pages[:100]:
        body = re.search(r"<(article|main)\b.*?</\1>", page, re.S)
        text = htmltext.extract(page)
        assert text and (body is None or all(w in re.sub(r"\s+", " ", __import__("html").unescape(re.sub(r"<[^>]+>", " ", body[0]))) for w in text.split("\n")[-1].split(" ")[:3]))


def test_odd_pages(spark):
    long_ = "<article>" + "<p>One, two, three; it goes on and on, as it may.</p>" * 20_000 + "</article>"
    rows = [(1, "u", "<p>One, two.</p>", "x"), (1, "u", "<p>One, two.</p>", "x"), (None, None, "<div>a<b>c", None), (2, None, None, ""), (3, "", "", ""), (4, "v", "<<<>>> &bogus; &#x41; <p", "y"), (5, "w", long_, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract_pages(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    held = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in got.collect()), key=str)
    assert [x for x in held if x[0] == 1] == [(1, "One, two.", 9)] * 2 and (2, "", 0) in held and (3, "", 0) in held
    assert max(len(t) for _, t, _ in held) == 20_000 * len("One, two, three; it goes on and on, as it may.") + 19_999 and all(n == len(t) for _, t, n in held)
    assert htmltext.extract_pages(df.where("false")).count() == 0
