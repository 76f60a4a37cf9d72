import math
import random

import numpy as np

from feedlens.llm import toxicity as tox


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        up, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(up[j - 1] + (x != y), up[j] + 1, row[-1] + 1))
    return row[-1]


def test_automaton_matches_edit_distance():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(40)]
    lexicon = tox.Lexicon([t + tox.END for t in terms], fuzzy_from=5)
    for _ in range(2000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
        want = min((d for t in terms if (d := distance(t, word)) <= (1 if len(t) >= 5 else 0)), default=None)
        got = lexicon.match(word)
        assert (got[1] if got else None) == want
        assert not got or distance(terms[got[0]], word) == got[1]


def test_stems_and_quotation():
    lexicon = tox.Lexicon(["idiot$", "lowei*"])
    assert lexicon.match("loweischaft") == (1, 0) and lexicon.match("lowe") is None and lexicon.match("idoit") is None and lexicon.match("idiott") == (0, 1)
    abuse, quoted = tox.features("you are an idiot", lexicon), tox.features('they said "idiot" then', lexicon)
    assert abuse[0] > 0 and abuse[4] > 0 and quoted[3] > 0 and quoted[4] == 0
    assert not tox.features(None, lexicon).any() and not tox.features("", lexicon).any()


def corpus(rng, n, start):
    bad = ["idiot", "grobl", "vilenix"]
    rows, labels = [], []
    for i in range(start, start + n):
        words = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            w = rng.choice(bad)
            words.insert(rng.randrange(len(words)), w + ("" if w != "grobl" else "".join(rng.choice("aeio") for _ in range(3))))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_terms_and_stems(spark):
    rng = random.Random(3)
    rows, labels = corpus(rng, 600, 0)
    held, truth = corpus(rng, 200, 1000)
    docs = spark.createDataFrame(rows + [(5000, None), (5001, ""), rows[0]], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(5000, 1), (None, 1), (77777, 0), labels[0]], "doc_id long, toxic int")
    model = tox.train(docs, known)
    data = spark.createDataFrame([(*r, "clash") for r in held] + [(1, None, "x"), (2, "", "x"), (3, "said " * 50000, "x")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r["score"] for r in tox.score_toxicity(data, model).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y in truth]
    assert sum(right) / len(right) > 0.97
    assert got[1] == got[2] < 0.5 and 0 <= got[3] <= 1


def test_without_labels_or_rows(spark):
    docs, labels = spark.createDataFrame([(1, "idiot")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    assert len(model.terms) == len(tox.SEED_WORDS)
    assert tox.score_toxicity(docs.where("doc_id < 0"), model).collect() == []
    assert tox.score_toxicity(docs, model).first()["score"] < 0.5


def brute_hit(word, terms):
    """(edits, whether a stem) of the closest term, whole words first among equals."""
    found = []
    for term in terms:
        name, stem = term[:-1], term[-1] == tox.STEM
        allowed = int(len(name) >= (7 if stem else 5))
        d = min((distance(name, word[:k]) for k in range(1, len(word) + 1)), default=99) if stem else distance(name, word)
        if d <= allowed:
            found.append((d, stem))
    return min(found, default=None)


def brute_score(text, terms, coef, bias):
    tokens = tox.TOKEN.findall((text or "").lower())
    x = [0.0] * 7
    for i, token in enumerate(tokens):
        hit = brute_hit(token, terms)
        if not hit:
            continue
        near = tokens[max(0, i - 6) : i + 7]
        before, after = [t for t in tokens[max(0, i - 6) : i] if t in tox.QUOTES], [t for t in tokens[i + 1 : i + 7] if t in tox.QUOTES]
        if (len(before) % 2 == 1 and after) or any(t in tox.REPORTING for t in near):
            x[3] += 1
            continue
        x[1 if hit[0] else 2 if hit[1] else 0] += 1
        x[4] += 2 if any(t in tox.ADDRESS for t in near) else 1
    if tokens:
        x[5] = 100 * x[4] / len(tokens)
    x[6] = float(x[0] + x[1] + x[2] > 0)
    return 1 / (1 + math.exp(-(sum(c * math.log1p(v) for c, v in zip(coef, x)) + bias)))


def test_scores_match_a_plain_logistic_over_brute_force_hits(spark):
    rng = random.Random(9)
    terms = ["idiot$", "scum$", "grob*", "vilenix*", "mean$"]
    coef, bias = np.array([0.9, 0.5, 0.7, -0.4, 0.3, 0.2, 1.1]), -2.3
    pool = ["idiot", "idiots", "idoit", "scum", "scun", "grobian", "grab", "vilenixe", "vilemixa", "mean", "means", "you", "said", "table", "sky", '"', "Idiot,", "“", "”"]
    rows = [(n, " ".join(rng.choice(pool + ["word", "other", "thing"] * 4) for _ in range(rng.randint(0, 40)))) for n in range(150)] + [(900, None), (901, "")]
    got = tox.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), tox.ToxicityModel(terms, coef, bias)).collect()
    text = dict(rows)
    for r in got:
        assert abs(r["score"] - brute_score(text[r["doc_id"]], terms, coef, bias)) < 1e-9, text[r["doc_id"]]


def test_more_terms_than_before_and_long_words(spark):
    long = "x" * 30
    rows = [(n, f"{long} term{n // 5}abc {n}") for n in range(100)] + [(200 + n, f"plain words here {n}") for n in range(100)]
    labels = [(n, 1) for n in range(100)] + [(200 + n, 0) for n in range(100)]
    model = tox.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert tox.Lexicon(model.terms).match(long)
