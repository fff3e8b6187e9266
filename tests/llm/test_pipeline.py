import sys
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import Row

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as p  # noqa: E402

COMMON = "the of and to in that is was for on with as it at by this from or be an".split()


def text(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.5 else "".join(rng.choice(list("aeioustrnl"), rng.integers(3, 9))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(5)
    clean = [text(rng, int(rng.integers(80, 200))) for _ in range(60)]
    passage = text(rng, 55)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[1].replace("the", "da", 1) if "the" in clean[1] else clean[1])]  # copies
    rows += [(200 + i, text(rng, 59) + f" xq{i} {passage} zq{i} " + text(rng, 59)) for i in range(3)]
    rows += [(300, "spam " * 400), (301, ""), (302, None)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source=f"s{i % 3}", n_chars=len(t or "")) for i, t in rows])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    kept = docs
    seen = {}
    for name, stage in p.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if name != names[-1]:
            assert sorted(kept.columns) == sorted(docs.columns)
        seen[name] = kept.collect()
    ids = {n: Counter(r.doc_id for r in seen[n]) for n in names}
    assert set(ids["quality"]) == {i for i, _ in rows if i < 300}
    assert set(ids["near_dedup"]) == {i for i, _ in rows if i < 300} - {100, 101}
    after = {r.doc_id: r.text for r in seen["substrings"]}
    assert all(after[i] == clean[i] for i in range(60))
    for i in range(200, 203):
        before = dict(rows)[i].split()
        assert after[i].split() == before[:60] + before[115:]
    assert max(ids["mixing"].values()) <= 3
    import sentencepiece

    from lineagram.llm.sentencepiece import default_model

    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for r in seen["tokens"][:20]:
        assert list(r.ids) == library.encode(after[r.doc_id]) and r.decoded == library.decode(list(r.ids))
    assert p.run(spark, str(tmp_path)).count() == len(seen["tokens"])


def test_null_and_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(7)
    clean = [text(rng, 120) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(clean[:30])]
    rows += [(None, clean[30]), (None, clean[31]), (None, clean[30]), (5, clean[32]), (5, clean[33]), (7, clean[5]), (None, clean[6])]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, lang=None if k % 2 else "en", source=None, n_chars=len(t), extra=k % 3, __keep="clash") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, extra int, __keep string")
    kept = docs
    for name, stage in p.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([*((i, t) for i, t in rows[:30]), (None, clean[30]), (None, clean[31]), (5, clean[32]), (5, clean[33])])
    mixed = p.mixing_stage(spark, kept, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
