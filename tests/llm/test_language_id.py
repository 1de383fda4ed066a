from vellumlake.llm import common
from vellumlake.llm import language_id as L


def test_documents_and_pages(spark):
    sf = "/root/testdata/sf0.01"
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    m = L.learn(docs)
    got = L.fused(L.evidence(docs, pages, m), m.languages).collect()
    assert len(got) == docs.count() + pages.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    by_doc = [r.lang == truth[r.doc_id] for r in got if r.kind == "document"]
    assert sum(by_doc) / len(by_doc) > 0.97
    by_page = [r.lang == r.declared for r in got if r.kind == "page" and r.declared]
    assert sum(by_page) / len(by_page) > 0.9


def test_evidence_stands_in_for_text(spark):
    docs = spark.createDataFrame([(i, "der und die das ist " * 5 if i % 2 else "the and of that is " * 5, "de" if i % 2 else "en", f"h{i % 2}") for i in range(60)], "doc_id bigint, text string, lang string, source string")
    page = lambda i, lang: (i, f"http://a.example.{'de' if lang == 'de' else 'com'}/{lang}/x", f'<html lang="{lang}"><body>{"der und die" if lang == "de" else "the and of"} <script>the</script></body></html>')
    pages = spark.createDataFrame([page(i, "de" if i % 2 else "en") for i in range(40)] + [(90, "http://a.example.de/de/y", '<html lang="de-AT"><body></body></html>'), (91, None, None), (92, "nonsense", "<html>")], "page_id bigint, url string, html string")
    m = L.learn(docs)
    got = {r.page_id: r for r in L.fused(L.evidence(docs, pages, m), m.languages).collect() if r.kind == "page"}
    assert got[90].lang == "de" and got[90].declared == "de" and got[90].text_lang is None and got[91].lang in m.languages and got[92].suffix is None


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    m = L.learn(docs)
    assert m.languages == () and L.fused(L.evidence(docs, None, m), m.languages).count() == 0
    some = spark.createDataFrame([(1, "x", None, None)], docs.schema)
    assert L.fused(L.evidence(some, None, L.learn(some)), ()).first().lang is None


def test_every_letter_counts(spark):
    """Letters beyond the 256 lowest code points, in words that the model hasn't seen."""
    low = [chr(c) for c in range(0x100, 0x500) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    kana, hangul = [chr(c) for c in range(0x3042, 0x3082)], [chr(c) for c in range(0xAC00, 0xAC40)]
    alphabets = {"la": low, "ja": kana, "ko": hangul}
    assert len(low) > 256
    docs = spark.createDataFrame([(i, "".join(a), x, "h") for i, (x, a) in enumerate(alphabets.items())], "doc_id bigint, text string, lang string, source string")
    m = L.learn(docs)
    assert set(m.letters) >= {*low, *kana, *hangul}
    unseen = spark.createDataFrame([(i, "".join(a[::-1][:40]), None, "h") for i, a in enumerate(alphabets.values())], docs.schema)
    got = {r.doc_id: r.text_lang for r in L.fused(L.evidence(unseen, None, m), m.languages).collect()}
    assert got == dict(enumerate(alphabets))


def test_letters_of_words_beyond_the_model(spark):
    docs = spark.createDataFrame([(i, t, x, "h") for i, (t, x) in enumerate([("aa aa", "en"), ("あい", "ja"), ("가각", "ko")])], "doc_id bigint, text string, lang string, source string")
    assert set(L.learn(docs, words=1).letters) == set("あい가각")


def words_of(alphabet, seed, n):
    import random

    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_scripts_without_spaced_words(spark):
    """Thai, Japanese and Arabic texts of one long word each, unseen in training."""
    scripts = {"th": [chr(c) for c in range(0xE01, 0xE2F)], "ja": [chr(c) for c in range(0x3041, 0x3094)] + list("日本語学校"), "ar": [chr(c) for c in range(0x627, 0x64B) if chr(c).isalpha()], "en": list("abcdefgh ")}
    docs = spark.createDataFrame([(i * 10 + k, words_of(a, (i, x).__repr__(), 80), x, "h") for i in range(20) for k, (x, a) in enumerate(scripts.items())], "doc_id bigint, text string, lang string, source string")
    m = L.learn(docs)
    unseen = spark.createDataFrame([(k, words_of(a, f"new {x}", 60), None, "h") for k, (x, a) in enumerate(scripts.items())], docs.schema)
    got = {r.doc_id: r.text_lang for r in L.fused(L.evidence(unseen, None, m), m.languages).collect()}
    assert [got[k] for k in range(3)] == ["th", "ja", "ar"]


def test_the_model_does_not_depend_on_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    copies = docs.unionAll(docs.limit(300)).orderBy(L.F.rand(7)).repartition(7)
    a, b = L.learn(docs, sample=100), L.learn(copies, sample=100)
    assert a.languages == b.languages and a.words == b.words and a.letters == b.letters and (a.table == b.table).all() and (a.letter_table == b.letter_table).all()
    assert L._least(docs.where("lang is not null and text is not null").select("text", "lang"), 100).count() == 100


def test_many_languages_stay(spark):
    docs = spark.createDataFrame([(i, f"word{i} word{i}", f"l{i}", "h") for i in range(300)], "doc_id bigint, text string, lang string, source string")
    assert len(L.learn(docs).languages) == 300


def test_stripping_equals_the_plain_pattern_and_is_linear():
    import random
    import re
    import time

    pattern = re.compile(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng, parts = random.Random(1), ["<script>", "</script>", "<style x>", "</style >", "<!--", "-->", "<", ">", "a", "<b>", "</scrip", "script", " ", "é", "<SCRIPT", "&amp;"]
    for _ in range(5000):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert L.plain(html) == L._ENTITY.sub(" ", pattern.sub(" ", html)), html
    for unit in ("<!--", "<script>", "<", "<script", "</script ", "<style><script>"):
        began = time.perf_counter()
        L.plain(unit * (5_000_000 // len(unit)))
        assert time.perf_counter() - began < 5


def test_long_and_odd_pages(spark):
    unit = ["<html ", "<meta http-equiv=content-language ", " lang", "x." * 3, "<!--"]
    rows = [(i, f"http://{'a.' * 9000}org/{u}", u * 200_000) for i, u in enumerate(unit)] + [(9, "http://h.org/", '<meta name=x><META content="fr-FR" http-equiv="Content-Language">'), (9, "http://h.org/", '<meta name=x><META content="fr-FR" http-equiv="Content-Language">')]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id bigint, url string, html string, text_ll string, rows string")
    docs = spark.createDataFrame([(1, "le la les", "fr", "s"), (2, "the of", "en", "s")], "doc_id bigint, text string, lang string, source string")
    m = L.learn(docs)
    got = [r for r in L.fused(L.evidence(docs, pages, m), m.languages).collect() if r.kind == "page"]
    assert len(got) == 7 and [r.declared for r in got if r.page_id == 9] == ["fr", "fr"]


def plain_fusion(rows, n):
    """Posterior sums and log-odds by plain loops over evidence rows."""
    import math

    posts = []
    for r in rows:
        e = [math.exp(x - max(r.text_ll)) for x in r.text_ll]
        posts.append([x / sum(e) for x in e])

    def sums(key):
        out = {}
        for r, p in zip(rows, posts):
            if key(r) is not None:
                s = out.setdefault(key(r), [0.0] * n)
                for i in range(n):
                    s[i] += p[i]
        return out

    whole = [sum(p[i] for p in posts) for i in range(n)]
    prior = [(g + 1) / (sum(whole) + n) for g in whole]
    declared, suffix = sums(lambda r: r.declared), sums(lambda r: r.suffix)
    domains, hosts = sums(lambda r: r.domain), sums(lambda r: None if r.host is None else (r.kind, r.host))
    told = lambda s, i: math.log((s[i] + 2 * prior[i]) / (sum(s) + 2) / prior[i])
    out = []
    for r, p in zip(rows, posts):
        d = domains.get(r.domain)
        base = prior if d is None else [(d[i] + L.SMOOTH_DOMAIN * prior[i]) / (sum(d) + L.SMOOTH_DOMAIN) for i in range(n)]
        h = hosts.get((r.kind, r.host))
        own = max(0.0, (sum(h) if h else 0.0) - 1)
        ll = []
        for i in range(n):
            x = r.text_ll[i] - max(r.text_ll)
            x += told(declared[r.declared], i) if r.declared is not None else 0
            x += told(suffix[r.suffix], i) if r.suffix is not None else 0
            ll.append(x + math.log((max(0.0, (h[i] if h else 0.0) - (p[i] if h else 0.0)) + L.SMOOTH_HOST * base[i]) / (own + L.SMOOTH_HOST)))
        z = [math.exp(x - max(ll)) for x in ll]
        out.append((ll.index(max(ll)), 1 / sum(z)))
    return out


def test_fusion_equals_plain_loops_with_and_without_broadcasts(spark, sf_dir, monkeypatch):
    import pytest

    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    m = L.learn(docs)
    rows = L.evidence(docs, pages, m).collect()
    want = {(r.kind, r.doc_id, r.page_id): w for r, w in zip(rows, plain_fusion(rows, len(m.languages)))}
    for bound, least in ((common.BROADCAST_BYTES, 1000), (0, 20)):
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(common, "HOT_ROWS", least)
        got = L.fused(spark.createDataFrame(rows, L.evidence(docs, pages, m).schema), m.languages).collect()
        assert len(got) == len(rows)
        for r in got:
            i, confidence = want[r.kind, r.doc_id, r.page_id]
            assert r.lang == m.languages[i] and r.confidence == pytest.approx(confidence, rel=1e-6)
