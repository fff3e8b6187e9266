import hashlib

import numpy as np
from pyspark.sql import Row

from lineagram.llm import suffix as s


def brute(rows, window=50):
    key = lambda d: (d is None, d or 0)
    first = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if w not in first or key(d) < first[w]:
                first[w] = key(d)
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, np.int8)
        for i in range(len(raw) - window + 1):
            if first[raw[i : i + window]] < key(d):
                gone[i : i + window] = 1
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted(rng):
    draw = lambda n: "".join(rng.choice(list("abcdé ßxyz\n"), n))
    passages = [draw(int(rng.integers(30, 140))) for _ in range(8)] + ["ab" * 60, " " * 70]
    rows = []
    for i in range(70):
        t = draw(int(rng.integers(0, 300)))
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(t) + 1))
            t = t[:at] + passages[int(rng.integers(len(passages)))] + t[at:]
        rows.append((int(rng.integers(0, 10**6)) * 100 + i, t))
    p = "q" * 49
    rows += [(1, ""), (2, None), (3, p), (4, p + "r"), (5, "z" + p), (6, p + "r"), (7, "x"), (8, "n" * 400), (9, "n" * 90), (-5, rows[0][1]), (rows[1][0], rows[1][1] + "tail"), (None, rows[2][1]), (None, rows[2][1])]
    return rows


def test_equals_brute_force(spark, tmp_path):
    rows = planted(np.random.default_rng(4))
    spark.createDataFrame([Row(doc_id=d, text=t, spans="clash") for d, t in rows], "doc_id long, text string, spans string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[:5] for r in s.op5_suffix(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_suffix_classes():
    rng = np.random.default_rng(9)
    for letters, n in ((2, 900), (4, 3000), (1, 420)):
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        text[n // 2 : n // 2 + 200] = text[10:210]
        text[-120:] = text[20:140]
        starts = np.flatnonzero(rng.random(n - 49) < 0.97)
        order, cls = s.suffix_classes(text, starts, 50)
        words = [text[i : i + 50].tobytes() for i in order]
        assert words == sorted(words) and sorted(order) == list(starts)
        assert [a != b for a, b in zip(words, words[1:])] == list(np.diff(cls) == 1)


def test_empty_table(spark):
    assert s.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_that_are_no_numbers(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(80))
    rows = [("x", text), ("7", text), (None, text + "!"), ("y", "short")]
    got = {(r.doc_id, r.n_removed) for r in s.remove(spark.createDataFrame(rows, "doc_id string, text string").repartition(2)).collect()}
    assert got == {("x", 80), ("7", 0), (None, 80), ("y", 0)}  # what is no number counts as the largest, and as one document


def test_shards_of_a_slice_are_merged(monkeypatch):
    """Windows' smallest owners are the same however many suffix arrays there are."""
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, 400).astype(np.uint8)
    parts = [base[a : a + 50 + int(rng.integers(0, 40))] for a in rng.integers(0, 250, 120)]
    sizes, owners = np.array([len(p) - 49 for p in parts]), rng.integers(0, 1000, len(parts))
    least = {}
    for p, o in zip(parts, owners):
        for i in range(len(p) - 49):
            w = p[i : i + 50].tobytes()
            least[w] = min(least.get(w, 1 << 60), int(o))
    want = [least[p[i : i + 50].tobytes()] for p in parts for i in range(len(p) - 49)]
    for shard in (1 << 19, 900, 60):
        monkeypatch.setattr(s, "SHARD", shard)
        assert s.first_owners(np.concatenate(parts), sizes, owners, 50).tolist() == want
