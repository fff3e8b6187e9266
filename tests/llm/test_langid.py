import numpy as np
from pyspark.sql import Row

from lineagram.llm import langid as g

SYLLABLES = {"aa": "ka lo mi tu ra ne".split(), "bb": "scho wer pf ung ich ei".split(), "cc": "ció ña rro lle que os".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 4)))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        lang = list(SYLLABLES)[i % 3]
        rows.append(Row(doc_id=i, text=text(rng, lang, int(rng.integers(3, 120))), lang=lang, score="clash"))
    docs = spark.createDataFrame(rows)
    model = g.fit(docs.where(~g.held_out()))
    assert model.langs == ["aa", "bb", "cc"]
    got = g.predict(docs, model).where(g.held_out()).collect()
    assert len(got) > 100
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([Row(text=t) for t in (None, "", "123 .,!", "×÷ “”", "ka", "ñ", "ka lo " * 50000)])
    preds = [r.lang_pred for r in g.predict(odd, model).collect()]
    assert preds[:4] == ["und"] * 4 and "und" not in preds[4:]
    again = g.fit(docs.where(~g.held_out()).repartition(7))
    assert (again.logits == model.logits).all()


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = g.fit(docs)
    assert g.predict(docs, model).count() == 0
    assert g.predict(spark.createDataFrame([("abc",)], "text string"), model).first().lang_pred == "und"


def test_one_text_in_most_rows_and_other_scripts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [Row(text="ka lo mi tu ra", lang="aa")] * 3000
    rows += [Row(text=text(rng, lang, 20), lang=lang) for lang in SYLLABLES for _ in range(80)]
    tifinagh = "ⵜⴰⵎⴰⵣⵉⵖⵜ ⴰⵎⴰⵣⵉⵖ".split()
    rows += [Row(text=" ".join(rng.choice(tifinagh, 12)) + " %d" % i, lang="zz") for i in range(80)]
    monkeypatch.setattr(g, "SAMPLE", 10**6)
    docs = spark.createDataFrame(rows)
    assert len(g._sampled(docs, "lang", 10**6)) <= 3 * len(set(rows))
    model = g.fit(docs)
    got = g.predict(spark.createDataFrame([Row(text="ⴰⵎⴰⵣⵉⵖ ⵜⴰⵎⴰⵣⵉⵖⵜ ⴰⵎⴰⵣⵉⵖ"), Row(text="ka lo mi"), Row(text="ka lo mi")]), model).collect()
    assert [r.lang_pred for r in got] == ["zz", "aa", "aa"] and got[1] == got[2]


def test_prediction_equals_its_definition(spark):
    """Mean logits of hashed subwords, by slicing each text."""
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([Row(text=text(rng, lang, 30), lang=lang) for lang in SYLLABLES for _ in range(40)])
    model = g.fit(docs)
    texts = [text(rng, "aa", 5), "Ka lo-mi 7 scho", "ció ña", "x", text(rng, "bb", 300)] * 2
    got = [(r.lang_pred, r.score) for r in g.predict(spark.createDataFrame([Row(text=t) for t in texts]).coalesce(1), model).collect()]
    for t, (lang, score) in zip(texts, got):
        raw = g._letters(np.frombuffer(t.encode(), np.uint8)).tobytes()
        logits, n = np.zeros(len(model.langs)), 0
        for k in range(1, g.LONGEST + 1):
            for i in range(len(raw) - k + 1):
                gram = raw[i : i + k]
                if b" " in gram[1:-1] or not gram.strip():
                    continue
                h = (int.from_bytes(gram, "little") + k * 0x9E3779B97F4A7C15) * 0xFF51AFD7ED558CCD % (1 << 64) >> 49
                logits += model.logits[h]
                n += 1
        z = (logits / max(n, 1) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert lang == model.langs[int(p.argmax())] and abs(score - p.max()) < 1e-6
