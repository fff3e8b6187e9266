import re

import numpy as np
import xxhash
from pyspark.sql import Row

from lineagram.llm import simhash as s


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 400)))) for _ in range(150)]
    for i in range(100):
        t = texts[i].split()
        t[int(rng.integers(len(t)))] = "edit"
        texts.append("\n".join(t))
    texts += ["", None, " ", "a", "A b", "É b", texts[3], texts[3].upper(), "long " * 30000]
    spark.createDataFrame([Row(doc_id=i, text=t, fp="clash") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in s.op10_simhash(spark, str(tmp_path)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == brute_components(prints)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in s.dedup(docs).collect()) == sorted(set(brute_components(prints)))


def test_tiles_find_all_links(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(6):
            x = int(b)
            for k in rng.integers(0, 63, int(rng.integers(1, 4))):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    want = brute_components(fps)
    for tile in (32768, 3):
        monkeypatch.setattr(s, "TILE", tile)
        got = {r.node: r.label for r in s.components(s.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2)).collect()}
        assert [got.get(f, f) for f in fps] == [fps[i] for i in want]


def test_empty_and_null_ids(spark):
    assert s.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = s.classes(spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d")], "doc_id long, text string")).collect()
    assert [r.component_id for r in got] == [5, 5, 5]


def test_near_dedup_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = ["w%d" % i for i in range(500)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 130)))) for _ in range(60)]
    for i in range(60):
        t = texts[i].split()
        for _ in range(int(rng.integers(1, 4))):
            t[int(rng.integers(len(t)))] = "edit"
        texts.append(" ".join(t))
    texts += ["", None, " ", "a b", "A\nb", texts[3]]

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = sets[i] | sets[j]
            if not union or len(sets[i] & sets[j]) / len(union) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, size="clash", node=1) for i, t in enumerate(texts)])
    for side in (16384, 9):
        monkeypatch.setattr(s, "SIDE", side)
        got = s.near_dedup(docs)
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == sorted(set(root))
    assert s.near_dedup(docs.limit(0)).count() == 0


def test_near_dedup_null_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["w%d" % i for i in range(500)], 40)) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0]), (None, texts[4] + " tail"), (9, texts[4]), (9, texts[5]), (9, texts[6]), (9, texts[6]), (7, texts[6].upper()), (3, texts[7]), (None, texts[7])]
    got = s.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, t) for t in texts[:4]] + [(9, texts[4]), (9, texts[5]), (7, texts[6].upper()), (3, texts[7])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def components_at(sets, similar=0.8):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= similar:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def near_line(rng):
    """Texts of 150 to 2000 words, and others with similarities of 0.75 to 0.86 to them, by tails and by changed words."""
    words = np.array(["w%d" % i for i in range(3000)])
    texts = []
    for k in range(60):
        t = rng.choice(words, int(rng.integers(150, 2000)))
        texts.append(t)
        share = rng.uniform(0.75, 0.86)
        if k % 2:
            texts.append(np.concatenate([t, rng.choice(words, int(len(t) / share) - len(t))]))
        else:
            u = t.copy()
            u[rng.choice(len(u), max(1, int(len(u) * (1 - share) / (1 + share) / 5)), replace=False)] = "edit"
            texts.append(u)
    return [" ".join(t) for t in texts]


def test_forest_is_exact():
    texts = near_line(np.random.default_rng(12))
    hashes = [np.unique(np.array(s.fingerprint_of(t.encode(), 5), np.uint64)) for t in texts]
    root = list(range(len(texts)))
    for i, j in zip(*s._forest(hashes)):
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    assert root == components_at([set(h.tolist()) for h in hashes])


def test_near_dedup_is_exact_for_long_texts(spark, monkeypatch):
    texts = near_line(np.random.default_rng(10))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = sorted(set(components_at(sets)))
    assert 70 < len(want) < 110
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for lot in (1 << 20, 1500):
        monkeypatch.setattr(s, "LOT", lot)
        assert sorted(r.doc_id for r in s.near_dedup(docs).collect()) == want
