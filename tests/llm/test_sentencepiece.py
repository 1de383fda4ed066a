import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece

from vellumlake.llm import sentencepiece_bpe as S

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return S.model(PATH)


TEXTS = ["", " ", "a", "  two  spaces ", "line\n\n\tnext", "▁ escaped", "é ñ ß 你好 😀", "<s> <0x41> </s>", "\x00\x7f\x85", " " * 100, "x" * 5000, "word " * 3000, "the" * 999]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(model, library, text):
    ids = library.encode(text)
    assert model.encode(text) == ids
    n, joined, back = model.encoded(text)
    assert (n, joined, back) == (len(ids), ",".join(map(str, ids)), library.decode(ids)) and model.decode(ids) == back


def test_random_texts(model, library):
    random.seed(1)
    alphabet = " \n\t▁abcthe.é😀你好\x00ñß1234<>" + " " * 6
    for _ in range(3000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 60)))
        assert model.encode(text) == library.encode(text), repr(text)


def test_random_ids(model, library):
    random.seed(2)
    for _ in range(3000):
        ids = [random.randint(3, 31999) if random.random() < 0.5 else random.randint(3, 258) for _ in range(random.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(S, "UNITS", 3)
    m = S.PieceModel(PATH)
    text = "several different words that don't fit the table of units 😀 " * 3
    assert m.encoded(text)[1] == ",".join(map(str, library.encode(text)))


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: library.encode(r.text) for r in docs.collect()}
    for r in S.encode_decode(docs, PATH).collect():
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = S.encode_decode(df, PATH, keep_ids=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, len(r.ids)) for r in got) == [(0, 0, 0), (1, 0, 0), (1, 0, 0), (2, 2, 2)]
    assert S.encode_decode(df.limit(0), PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises(ValueError):
        S.PieceModel(str(tmp_path / "m"))
