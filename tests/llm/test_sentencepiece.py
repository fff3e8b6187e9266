import hashlib
import random

import pytest
from pyspark.sql import Row

sentencepiece = pytest.importorskip("sentencepiece")

from lineagram.llm import sentencepiece as sp  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.default_model())


@pytest.fixture(scope="module")
def codec():
    return sp.Codec(open(sp.default_model(), "rb").read())


def test_random_text_equals_library(codec, library):
    rng = random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice("aaabe thei r nsol  \n\t▁é你😀0 1,.<>\x00_ ") for _ in range(rng.randint(0, 60)))
        assert codec.encode(s) == library.encode(s)
        assert codec.decode(codec.encode(s)) == library.decode(library.encode(s))


def test_pair_walk_equals_definition(codec):
    rng, tokens = random.Random(4), [t for t in codec.right if t[-1] != sp.MARK]
    for _ in range(20000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert codec.merges_across(a, b) != (codec._merge(a + b) == [a, b])


def test_one_long_word(codec, library):
    s = "abracadabra" * 5000
    assert codec.encode(s) == library.encode(s)


def test_rows(spark, tmp_path, library):
    texts = ["", None, " ", "a  b", "Ein Satz.\nNoch einer", "x" * 3000, "same", "same"]
    spark.createDataFrame([Row(doc_id=i, text=t, ids="clash", decoded=1.5) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sp.op9_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    clash = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sp.encode_decode(clash).columns == ["doc_id", "text", "ids", "decoded"]
    back = sp.decode(sp.encode(clash)).where("doc_id = 3").first()
    assert back.decoded == "a  b"


def test_empty_table(spark):
    assert sp.encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_memos_and_odd_tables(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sp, "MEMO", 5)
    monkeypatch.setattr(sp, "PAIRS", 7)
    codec, library = sp.Codec(sp._model_bytes(spark, None)), sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    text = "The quick brown fox jumps, unbelievably, over internationalisation and 12345 dogs; straße naïve 東京 the quick brown fox. " * 3
    for _ in range(3):
        assert codec.encode(text) == library.encode(text)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sp.encode_decode(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = sp.encode_decode(twice).collect()
    assert len(got) == 3 and [list(r.ids) for r in got if r.text] == [library.encode("a b")] * 2 and [list(r.ids) for r in got if not r.text] == [[]]
