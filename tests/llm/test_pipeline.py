"""Each stage against a brute-force version on its own input, and run() against the stages one after the other."""

import random

import pytest
from test_decontaminate import distance
from test_simhash import groups

import corpus_pipeline
from feedlens.llm.decontaminate import folded
from feedlens.llm.simhash import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, epochs string"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    text = lambda n: [word() for _ in range(n)]
    rows = [text(rng.randint(20, 120)) for _ in range(150)]
    passage, item = text(70), text(25)
    for n in range(0, 40, 5):
        rows[n][5:5] = passage
    for n in (50, 51, 52):
        rows[n][3:3] = [w.upper() for w in item]
    for n in range(60, 80):
        rows[n] = list(rows[60]) if n % 2 else rows[60][:-1] + [word()]
    toxic = set(range(1, 150, 9))
    for n in toxic:
        rows[n].insert(4, "grobulant")
    docs = [(n, " ".join(w), "en", f"src{n % 4}", len(" ".join(w)), "clash", "clash") for n, w in enumerate(rows)]
    docs += [(500, "", "en", "src1", 0, "x", "x"), (501, None, None, None, None, None, None), (None, "no id here", "en", "src1", 10, "x", "x")]
    labels = [(n, 1, int(n in toxic)) for n in range(150)]
    return docs, labels, [(0, " ".join(item)), (1, None)], toxic


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    docs, labels, items, _ = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_stages(spark, folder):
    _, labels, items, toxic = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, folder)
        docs = spark.createDataFrame(done.collect(), done.schema)
        if name != "mix":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            assert set(before) - set(after) == toxic
        elif name == "simhash":
            ids = [i for i in before if i is not None]
            linked = [(a, b) for a in ids for b in ids if a < b and jaccard(before[a], before[b], 5) >= 0.8]
            assert set(before) - set(after) == {i for i, g in groups(ids, linked).items() if g < i}
        elif name == "substrings":
            runs = lambda t: {tuple(w[i : i + 51]) for w in [(t or "").split()] for i in range(len(w) - 50)}
            seen = set()
            for i in sorted(i for i in after if i is not None):
                assert not runs(after[i]) & seen
                seen |= runs(after[i])
            shared = {i for i in before if any(runs(before[i]) & runs(before[j]) for j in before if j != i)}
            assert shared and all(after[i] == before[i] for i in before if i not in shared)
        elif name == "decontaminate":
            a = folded(items[0][1])
            near = {i for i, t in before.items() if i is not None and t and distance(a, folded(t)) <= int(0.12 * len(a))}
            assert near and set(before) - set(after) == near
        before = after
        out[name] = after
    rows = docs.collect()
    before = out["decontaminate"]
    assert {"domain", "epoch", "n_tokens"} <= set(docs.columns) and all(r["n_tokens"] == len(r["text"].split()) > 0 and r["n_chars"] == len(r["text"]) for r in rows)
    total = sum(len((t or "").split()) for t in before.values())
    assert 0.55 * total < sum(r["n_tokens"] for r in rows) <= 0.6 * total
    seen = {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append((r["epoch"], r["text"]))
    for i, epochs in seen.items():
        epochs.sort()
        assert [e for e, _ in epochs] == list(range(1, len(epochs) + 1)) and all(t == before[i] for _, t in epochs[:-1])
        assert " ".join(before[i].split()).startswith(" ".join(epochs[-1][1].split()))
    got = sorted((str(r["doc_id"]), r["epoch"], r["text"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == sorted((str(r["doc_id"]), r["epoch"], r["text"]) for r in rows)


def test_repeated_and_null_ids(spark, folder):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    one, two, three = text(120), text(130), text(140)
    item = corpus()[2][0][1]
    rows = [(1, one), (1, one), (1, two), (2, one), (3, two), (4, three + " " + one), (None, one), (None, item), (5, item), (5, three), (6, None), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "src1", 0, "s", "e") for i, t in rows], SCHEMA)
    key = lambda r: (str(r[0]), str(r[1]))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["simhash"](spark, docs, folder)
    assert kept.columns == docs.columns
    # equal rows are one, rows that share an id and differ in text are two documents, rows without id stay
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key)
    assert left == sorted([(1, one), (1, two), (4, three + " " + one), (None, one), (None, item), (5, item), (5, three), (6, None)], key=key) or (5, three) in left
    cut = stages["substrings"](spark, kept, folder)
    texts = sorted((str(r["doc_id"]), r["text"]) for r in cut.collect() if r["doc_id"] is None)
    assert texts == sorted([("None", one), ("None", item)])
    clean = stages["decontaminate"](spark, cut, folder)
    assert all(r["text"] != item for r in clean.collect())
    mixed = stages["mix"](spark, clean, folder)
    assert all(r["n_tokens"] == len(r["text"].split()) for r in mixed.collect())


def test_equal_rows_take_no_more_than_the_budget(spark, folder):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    same, also = text(100), text(60)
    rows = [(None, same)] * 50 + [(7, also)] * 30 + [(n, text(100)) for n in range(100, 150)]
    docs = spark.createDataFrame([(i, t, "en", "src1" if n % 2 else None, 0, "s", "e") for n, (i, t) in enumerate(rows)], SCHEMA).repartition(5)
    mixed = dict(corpus_pipeline.STAGES)["mix"](spark, docs, folder).collect()
    total = sum(len(t.split()) for _, t in rows)
    assert 0.55 * total < sum(r["n_tokens"] for r in mixed) <= 0.6 * total and all(r["n_tokens"] == len(r["text"].split()) for r in mixed)
    assert 5 < sum(r["doc_id"] is None for r in mixed) < 50


def test_intermediate_tables_go(spark, folder):
    from pathlib import Path

    from feedlens.llm.common import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("stored-*"))
    assert corpus_pipeline.run(spark, folder).count() and set(shared.glob("stored-*")) == before


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert not corpus_pipeline.run(spark, str(tmp_path)).collect()
