import re

import numpy as np
from pyspark.sql import Row

from lineagram.llm import quality as q

WORDS = "the of and to in that is was for on with as it at by this from or be an".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choice(list("aeioustrnl"), rng.integers(3, 9))) for _ in range(n))


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_signals_and_verdicts(spark):
    rng = np.random.default_rng(5)
    good = [sentence(rng, int(rng.integers(80, 300))) for _ in range(60)]
    odd = ["", None, " \n\t", "é" * 50, "x", "a b\na b\n\na b\n", " ".join(["again and"] * 40), "w\x00 " * 30, "\n".join([good[0]] * 3), "long " * 20000]
    bad = [re.sub(r"(\w+)", r"\1###", good[1]), good[2].upper() + "!!", " | | | ".join(good[3].split())]
    texts = good + odd + bad
    docs = spark.createDataFrame([Row(doc_id=i, text=t, lang="en" if i % 7 else None, kept="clash") for i, t in enumerate(texts)]).repartition(3)
    got = {r.doc_id: r for r in q.judge(docs).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert tuple(got[i][c] for c in q.SIGNALS) == want, t
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert all(got[i].kept for i in range(len(good)))
    verdicts = [got[len(good + odd) + k] for k in range(3)]
    assert not any(r.kept for r in verdicts), [(r.n_words, r.char_distance, r.word_distance) for r in verdicts]
    again = {r.doc_id: (r.kept, r.word_distance) for r in q.judge(docs.repartition(5)).collect()}
    assert again == {i: (r.kept, r.word_distance) for i, r in got.items()}


def test_empty_table(spark):
    assert q.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_distance():
    p = np.array([[0.5, 0.5, 0.0]])
    assert q.distance(p, p[0])[0] == 0
    assert abs(q.distance(np.array([[1.0, 0, 0]]), np.array([0, 1.0, 0]))[0] - 1) < 1e-12


def test_rare_languages_are_not_judged_by_others(spark):
    rng = np.random.default_rng(3)
    # one language of 6,000 words and one of 800 beside one of 7 million, so that the two are under 0.1 % of all words
    other = lambda i, k, n: " ".join("%s%d" % (k, rng.integers(12)) if rng.random() < 0.9 else sentence(rng, 1) for _ in range(n))
    big = [(1000 + i, sentence(rng, 250), "en") for i in range(70)]
    rare = [(i, other(i, "mid", 200), "mid") for i in range(30)] + [(100 + i, other(i, "few", 200), "few") for i in range(4)]
    docs = spark.createDataFrame(big, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "explode(sequence(1, 400)) as k").drop("k")
    docs = docs.unionByName(spark.createDataFrame(rare, "doc_id long, text string, lang string")).repartition(4)
    refs = q.learn(docs)
    assert refs.langs == ["en", "mid"]
    got = q.judge(docs.where("lang != 'en'"), refs=refs).collect()
    assert [r.doc_id for r in got if r.base_failed] == []
    assert sum(r.kept for r in got if r.lang == "mid") >= 28 and all(r.kept for r in got if r.lang == "few")
    assert all(r.word_distance > 0.2 + 2 / r.n_words**0.5 for r in got if r.lang == "few")  # over the limit by the others


def js(p, q_):
    m = (p + q_) / 2
    part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return np.sqrt(max((part(p) + part(q_)) / 2, 0))


def test_distances_and_verdicts_equal_brute_force(spark):
    """References, distances and verdicts from their definitions, word by word."""
    rng = np.random.default_rng(9)
    rules = q.Rules(min_lang=500)
    langs = {"en": lambda n: sentence(rng, n), "xx": lambda n: " ".join("%s%d" % (rng.choice(["żó", "la", "Mi"]), rng.integers(9)) for _ in range(n))}
    rows = [(i, langs["en" if i % 3 else "xx"](int(rng.integers(10, 200))), "en" if i % 3 else "xx") for i in range(90)]
    rows += [(200, rows[1][1].upper() + "!!", "en"), (201, "##".join(rows[2][1].split()), "en"), (202, rows[0][1], "en"), (203, rows[1][1], "zz"), (204, None, "en"), (1, rows[1][1], "en")]
    got = q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), rules).collect()

    def kinds(t):
        out = np.zeros(len(q.CLASSES))
        for c in t or "":
            size = len(c.encode())
            at = {2: 7, 3: 8, 4: 9}.get(size)
            if at is None:
                at = 0 if c in " \t\n\x0b\x0c\r" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 if c in ".,;:?'\"()-" else 5 if 33 <= ord(c) < 127 else 6
            out[at] += 1
        return out

    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    chars, words = {}, {}
    for _, t, lang in rows:
        w, _, _, _, repeated = brute(t)
        if w < 20 or 100 * repeated > 30 * w:
            continue
        k = kinds(t)
        chars[lang] = chars.get(lang, 0) + k * q.PARTS // k.sum()
        for x in low(t):
            words.setdefault(lang, {})[x] = words.get(lang, {}).get(x, 0) + 1
    refs = {a: (chars[a] / chars[a].sum(), {x: n / sum(words[a].values()) for x, n in words[a].items() if n / sum(words[a].values()) >= rules.common}) for a in words if sum(words[a].values()) >= rules.min_lang}
    assert sorted(refs) == ["en", "xx"]
    seen = set()
    for r in got:
        t = r.text
        w, _, _, _, repeated = brute(t)
        k = kinds(t)
        own = k / max(k.sum(), 1)
        by_char = min(js(own, c) for c, _ in refs.values())
        by_word = 1.0
        for _, common in refs.values():
            mine = np.array([low(t).count(x) / max(w, 1) for x in common])
            by_word = min(by_word, js(np.append(mine, max(1 - mine.sum(), 0)), np.append(list(common.values()), max(0.0, 1 - sum(common.values())))))
        assert abs(r.char_distance - by_char) < 1e-9 and abs(r.word_distance - by_word) < 1e-9, t
        failed = w < 20 or 100 * repeated > 30 * w
        kept = not failed and (by_char <= rules.max_char or k.sum() < rules.min_chars) and (by_word <= rules.max_word + rules.slack / np.sqrt(max(w, 1)) or w < rules.min_words or r.lang not in refs)
        assert (r.base_failed, r.kept) == (failed, kept)
        seen.add(kept)
    assert seen == {True, False} and len(got) == len(rows)
