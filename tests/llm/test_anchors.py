import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import Row

from lineagram.llm import anchors as a

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    docs = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = {i + k for i in range(len(d) - window + 1) if seen[tuple(d[i : i + window])] > 1 for k in range(window)}
        kept = " ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((len(d), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def planted(rng, n=60):
    words = ["w%d" % i for i in range(50)] + ["é", "ß!", "#"]
    draw = lambda k: list(rng.choice(words, k))
    passages = [draw(int(rng.integers(20, 80))) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = draw(int(rng.integers(0, 150)))
        if rng.random() < 0.5:
            at = int(rng.integers(0, len(t) + 1))
            t[at:at] = passages[int(rng.integers(len(passages)))]
        texts.append(" ".join(t).replace("w7 ", "w7\n\t "))
    p34, p35 = draw(34), draw(35)
    texts += [" ".join(draw(9) + p34 + draw(3)), " ".join(p34), " ".join(draw(5) + p35), " ".join(p35 + draw(5))]
    texts += ["", None, " ", "x", "y " * 200, texts[0], texts[0], " ".join(passages[0] * 2)]
    return texts


def test_equals_brute_force(spark, tmp_path):
    texts = planted(np.random.default_rng(11))
    spark.createDataFrame([Row(doc_id=i, text=t, n_words="clash") for i, t in enumerate(texts)]).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in a.op2_anchors(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 35)


def test_empty_table(spark):
    assert a.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_first_hashes_are_told_apart():
    h, h2 = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 3], np.uint32)
    first, twice, place = a._distinct(h, h2)
    assert list(zip(h[first], h2[first])) == [(5, 1), (5, 2), (9, 3)] and list(twice) == [True, False, False] and list(place) == [0, 1, 0, 2]
    pack = lambda h, c: a._body(np.array(h, np.uint64), np.array(c, np.uint32))
    got = dict(a._runs(0, [(1, pack([10, 20], [7, 8])), (2, pack([10, 20, 31], [7, 9, 4]))]))
    assert got == {1: pack([10], [7]), 2: pack([10, 31], [7, 4])}  # 20 has another second hash; 31 is marked as found twice


def test_null_and_repeated_ids(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None, "x " + passage), (None, "y " + passage), (3, "z"), (3, "only here")]
    got = a.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(1, 0), (2, 0), (41, 40), (41, 40)]
