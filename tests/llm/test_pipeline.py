import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as P
from tests.llm.test_near_dedup import brute
from vellumlake.llm import common, mixing, near_dedup, pii


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, f in P.STAGES:
        docs = f(spark, docs, sf_dir).cache()
        out[name] = docs.collect()
    return out


def test_stages_against_plain_versions(spark, sf_dir, stages):
    given = {r.doc_id: r for r in stages["documents"]}
    good = stages["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert all(given[r.doc_id] == r for r in good)
    assert sum(q == 1 and d in kept for d, q in labels.items()) >= 0.97 * sum(labels.values())
    one = stages["minhash_near_dedup"]
    want = brute([(r.doc_id, r.text) for r in good], 5)
    assert sorted(r.doc_id for r in one) == sorted(d for d, (_, _, k) in want.items() if k)
    clean = stages["pii_surrogates"]
    found = {r.e for r in pii.dictionary(spark.createDataFrame(one, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert len(clean) == len(one) and all(e not in r.text for e in found for r in clean)
    assert all(r.n_chars == len(r.text) for r in clean)
    mixed = stages["source_mixing"]
    assert {r.doc_id for r in mixed} == {r.doc_id for r in clean}
    plan = {r.source: r for r in mixing.plan(spark.createDataFrame(clean, "doc_id bigint, text string, lang string, source string, n_chars bigint"), P.TARGET_ENTROPY, P.MAX_REPETITION).plan.collect()}
    times = Counter(r.doc_id for r in mixed)
    assert all(int(plan[r.source].epochs) <= times[r.doc_id] <= int(plan[r.source].epochs) + 1 for r in clean)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {r.doc_id: sp.encode(r.text) for r in mixed}
    for r in stages["sentencepiece"]:
        assert r.n_tokens == len(ids[r.doc_id]) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()


def test_run(spark, sf_dir, stages):
    assert sorted(map(tuple, P.run(spark, sf_dir).collect())) == sorted(map(tuple, stages["sentencepiece"]))


def test_columns_and_empty_input(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, f in P.STAGES[:-1]:
        out = f(spark, empty, sf_dir)
        assert tuple(out.columns) == P.COLUMNS and out.count() == 0, name


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BASE = " ".join(f"word{i}" for i in range(60))


def odd_rows():
    near = BASE.replace("word7 ", "other ")
    rows = [(1, BASE), (2, BASE), (3, near), (None, BASE), (None, None), (4, None), (5, ""), (6, " \n"), (7, "mail a.b@c.example.com or call +1 (555) 123-4567"), (7, "mail a.b@c.example.com or call +1 (555) 123-4567"), (8, "x" * 300_000), (9, "long " + " ".join(f"v{i}" for i in range(150_000))), (10, "ties"), (11, "Ties"), (12, "e\u0301 \U0001f600 \x00")]
    return [(i, t, None if i == 10 else "en", None if i in (4, 11) else "s1" if i and i % 2 else "s2", None if t is None else len(t)) for i, t in rows]


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_each_stage_on_odd_rows(spark, sf_dir, monkeypatch, few):
    """Nulls in any column, repeated rows, ids and texts, very long texts: each stage on all of them, both ways of its joins."""
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 16 << 20 if few else 0)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    count = lambda got: Counter(map(tuple, got))
    judged = count(P.keep_quality(spark, docs, sf_dir).collect())
    assert not judged - count(rows) and {judged[r] for r in rows if r[:2] == rows[8][:2]} <= {0, 2}
    one = count(P.drop_near_copies(spark, docs, sf_dir).collect())
    assert one == count(r for r in rows if r[0] not in (2, 3, 11))
    new = P.replace_pii(spark, docs, sf_dir).collect()
    assert len(new) == len(rows) and count(r for r in new if r.doc_id != 7) == count(r for r in rows if r[0] != 7)
    a, b = (r for r in new if r.doc_id == 7)
    assert a == b and "a.b@c" not in a.text and "123-4567" not in a.text and a.n_chars == len(a.text)
    mixed = count(P.mix_sources(spark, docs, sf_dir).collect())
    assert set(mixed) == set(count(rows)) and all(mixed[r] >= n for r, n in count(rows).items())
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = P.to_pieces(spark, docs, sf_dir).collect()
    want = Counter((r[0], hashlib.sha256(",".join(map(str, sp.encode(r[1] or ""))).encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.ids_sha256) for r in got) == want
