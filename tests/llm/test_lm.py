import collections
import zlib

import numpy as np
from pyspark.sql import functions as F

from feedlens.llm import lm
from feedlens.llm.common import bucket_of

SMALL = lm.Shape(words=20, suffixes=4, dim=8, noise=8, head=30, batch=64, sample_tokens=5000)


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    out = []
    for n in range(120):
        at, own = rng.integers(60), []
        for _ in range(40):
            at = (at + 1) % 60 if rng.random() < 0.8 else rng.integers(60)  # the next word follows from the last
            own.append(words[at])
        out.append((n, " ".join(own)))
    return out + [(500, None), (501, ""), (502, " \t\n"), (503, "UPPER upper Ünï"), (None, "w1 w2"), (3, out[3][1])]


def test_base_score_and_gain(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    held = bucket_of(F.col("doc_id"), 5) == 1
    got = lm.score_texts(docs, docs.where(~held), shape=SMALL).collect()
    assert len(got) == len(rows)
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    counts = collections.Counter(w for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = {i: sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)) for i, t in rows}
    for r in got:
        own = tokens(dict(rows)[r["doc_id"]])
        assert r["train_tokens"] == n and r["n_tokens"] == len(own) and r["n_known"] == sum(counts[w] > 0 for w in own)
        assert abs(r["base_score"] - base[r["doc_id"]]) < 1e-6
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) * 0.9


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    share = np.full(9, 1 / 9)
    model = lm.start(9, share, 4)
    model.targets += rng.normal(size=model.targets.shape)
    a, b, z = lm.log10_tables(model)
    total = 10 ** (a[:, None, :] + b[None, :, :] - z[:, :, None]).astype(float)
    assert np.allclose(total.sum(axis=2), 1, atol=1e-4)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score_texts(docs, docs.where("doc_id < 0"), shape=SMALL).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 0, 0), (3, 0, 0)]
    assert not lm.score_texts(docs.where("doc_id < 0"), docs, shape=SMALL).collect()


def test_score_matches_a_plain_softmax(spark, monkeypatch):
    seen = {}

    def fixed(texts, coder, share, shape, n_all):
        rng = np.random.default_rng(4)
        model = lm.start(coder.n, share, shape.dim)
        model.targets[:] = rng.normal(size=model.targets.shape)
        model.vectors[:] = rng.normal(size=model.vectors.shape)
        model.first[:], model.second[:] = rng.normal(size=shape.dim), rng.normal(size=shape.dim)
        seen["model"] = model
        return model

    monkeypatch.setattr(lm, "train", fixed)
    rows = texts() + [(600, "w1 " * 30_000), (600, "w1 " * 30_000)]  # a very long text, twice
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = docs.where("doc_id < 80")
    got = lm.score_texts(docs, training, shape=SMALL).collect()
    assert len(got) == len(rows)
    words = lambda t: (t or "").encode().lower().split()
    learned = [t for i, t in rows if i is not None and i < 80]
    counts = collections.Counter(w for t in learned for w in words(t))
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    # the same cut as the operator's: those in the head by count, then the first 20 of them
    own = ranked[:20]
    mass = [0.5] * 4
    for w in counts:
        if w not in own:
            mass[zlib.crc32(w[-2:]) % 4] += counts[w] + 0.5
    place = {w: n + 1 for n, w in enumerate(own)}
    m = seen["model"]

    def score(text):
        one = two = m.vectors[len(own) + 1 + 4]
        total = 0.0
        for w in [*words(text), None]:
            at = 0 if w is None else place.get(w) or len(own) + 1 + zlib.crc32(w[-2:]) % 4
            logits = m.targets @ (one * m.first + two * m.second) + m.bias
            logits = logits - logits.max()
            total += (logits[at] - np.log(np.exp(logits).sum())) / np.log(10)
            if at > len(own):
                total += np.log10((counts[w] + 0.5) / mass[at - len(own) - 1])
            two, one = one, m.vectors[at]
        return total

    want = {i: score(t) for i, t in rows}
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-3 * max(1, abs(want[r["doc_id"]])), r["doc_id"]


def test_a_training_step_follows_the_gradient_of_noise_contrastive_estimation():
    from feedlens.llm import lm

    rng = np.random.default_rng(3)
    classes, dim, shape = 6, 3, lm.Shape(noise=4, rate=0.5)
    share = np.full(classes, 1 / classes)
    sizes = {"targets": (classes, dim), "bias": (classes,), "vectors": (classes + 1, dim), "first": (dim,), "second": (dim,)}
    p = {k: rng.normal(0, 0.5, n) for k, n in sizes.items()}
    trainer = lm.Trainer(lm.Model(**p), share, shape, seed=5)
    word, one, two = (rng.integers(0, n, 7) for n in (classes, classes + 1, classes + 1))
    noise = np.searchsorted(np.cumsum(share), np.random.default_rng(5).random(shape.noise))

    def objective(q):
        context = q["vectors"][one] * q["first"] + q["vectors"][two] * q["second"]
        floor = np.log(shape.noise / classes)
        true = (context * q["targets"][word]).sum(1) + q["bias"][word] - floor
        false = context @ q["targets"][noise].T + q["bias"][noise] - floor
        return -np.log1p(np.exp(-true)).sum() - np.log1p(np.exp(false)).sum()

    trainer.step(word, one, two)
    for name, before in p.items():
        gradient = np.zeros_like(before)
        for at in np.ndindex(before.shape):
            ends = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in p.items()}
                moved[name][at] += step
                ends.append(objective(moved))
            gradient[at] = (ends[0] - ends[1]) / 2e-5
        if name in ("first", "second"):  # the two factors take ten times the mean
            gradient *= 10 / len(word)
        want = before + shape.rate * gradient / np.sqrt(1 + gradient**2)
        assert np.allclose(trainer.p[name], want, atol=2e-4), name
