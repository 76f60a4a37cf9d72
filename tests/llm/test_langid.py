import random

import numpy as np

from feedlens.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "eit", "ber"], "cc": ["eau", "oux", "ière", "que"]}


def docs(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang))
    return out


def test_held_out_accuracy_and_odd_texts(spark):
    rows = docs(random.Random(2), 300)
    known = spark.createDataFrame(rows[:200] + [(900, None, "aa"), (901, "123", "aa"), (902, "text", None), rows[0]], "doc_id long, text string, lang string")
    model = langid.train(known, sample=120)
    odd = [(1000, None, "x"), (1001, "", "x"), (1002, "12 34 -- !", "x"), (1003, "Ka lo " * 20000, "x")]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows[200:] + odd, "doc_id long, text string, score string"), model).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows[200:]]
    assert sum(right) / len(right) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_learned_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(empty)
    one = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert langid.predict(one, model).first()["lang_pred"] == "und"
    assert not langid.predict(empty, model).collect()


def test_scores_match_direct_kernel_ridge_regression(spark):
    rows = docs(random.Random(5), 90)
    known, held = rows[:60], rows[60:]
    sets = [set(np.concatenate(langid.places(t)).tolist()) for _, t, _ in rows]
    kernel = lambda x, y: len(x & y) / (len(x) * len(y)) ** 0.5
    langs = sorted(SYLLABLES)
    y = np.array([langs.index(lang) for _, _, lang in known])
    k = np.array([[kernel(a, b) for b in sets[:60]] for a in sets[:60]])
    weight = np.diag(1 / (np.bincount(y) / len(y))[y])
    target = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    alpha = np.linalg.solve(weight @ k + 0.01 * 60 * np.eye(60), weight @ target)
    raw = np.array([[kernel(a, b) for b in sets[:60]] for a in sets[60:]]) @ alpha
    odds = np.exp(6.0 * (raw - raw.max(axis=1, keepdims=True)))
    want = odds.max(axis=1) / odds.sum(axis=1)
    model = langid.train(spark.createDataFrame(known, "doc_id long, text string, lang string"), sample=3000)
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(held, "doc_id long, text string, lang string"), model).collect()}
    for (i, _, _), row, score in zip(held, raw, want):
        assert got[i]["lang_pred"] == langs[int(row.argmax())] and abs(got[i]["score"] - score) < 2e-3
