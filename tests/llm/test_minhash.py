import random

import duckdb
import numpy as np
import pytest

from feedlens.llm import minhash, queries
from feedlens.llm.simhash import shingle_set


def sets(text, words=5):
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def brute(rows, percent=85):
    """(n_shingles, component) of each (id, text)."""
    found = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(found):
        for b in range(a):
            if x and found[b] and 100 * len(x & found[b]) >= percent * len(x | found[b]):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted((str(i), len(found[n]), str(least.get(find(n)))) for n, (i, _) in enumerate(rows))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed=0):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = [(n, fresh(rng.choice([1, 4, 5, 12, 60, 300]))) for n in range(40)]
    rows += [(n, edited(rng, rows[rng.randrange(40)][1], rng.randint(0, 2))) for n in range(40, 120)]
    base = fresh(120)
    rows += [(n, edited(rng, base, rng.randint(0, 3))) for n in range(200, 260)]  # a large group, some of whose pairs are linked
    chain = fresh(200)
    for n in range(300, 320):
        chain = edited(rng, chain, 2)
        rows.append((n, chain))
    line = fresh(40)
    rows += [(n, line + fresh(30)) for n in range(400, 430)]  # a passage that many share, not enough to be linked
    rows = [(n, ("\t " if n % 3 else " ").join(w).upper() if n % 5 == 0 else " ".join(w)) for n, w in rows]
    return rows + [(500, None), (501, ""), (502, " \n\t"), (503, "É é"), (504, "é é"), (None, rows[200][1]), (None, "nobody else says this here at all"), rows[7], (7, "another text of the same id")]


def result(spark, rows, **options):
    got = minhash.minhash_components(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n int"), **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = got.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found)


def test_matches_brute_force(spark):
    rows = corpus()
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, tile=4) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_keys_meet_within_the_threshold_and_signatures_follow_the_similarity():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 16, (200, minhash.SYMBOLS)).astype(np.uint16)
    two = one.copy()
    most = minhash.CHUNKS * (minhash.ERRORS + 1) - 1
    for n in range(200):
        at = rng.permutation(minhash.SYMBOLS)[:most]
        two[n, at] += 1
    a, b = minhash.chunk_keys(one), minhash.chunk_keys(two)
    assert all(set(x) & set(y) for x, y in zip(a, b)) and len(np.unique(a)) == a.size
    assert not any(set(x) & set(y) for x, y in zip(a, np.roll(b, 1, axis=0)))
    apart, met = [], 0
    for _ in range(400):
        shared, x, y = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (170, 15, 15))
        s, t = (minhash.symbols([minhash.signature(np.concatenate([shared, own]))]) for own in (x, y))
        apart.append(int((s != t).sum()))
        met += bool(set(minhash.chunk_keys(s)[0]) & set(minhash.chunk_keys(t)[0]))
    assert met == 400 and abs(np.mean(apart) - 0.15 * minhash.SYMBOLS) < 0.6 and max(apart) <= minhash.FAR


@pytest.mark.parametrize("n", [1, 511, 512, 1500])
def test_signature_in_blocks_is_that_of_the_whole(n):
    x = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    assert minhash.signature(x) == minhash.signature(x, block=1 << 20)


def test_a_very_long_text_and_its_copy(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(9)}{rng.randrange(90000)}" for _ in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 900))), (3, " ".join(edited(rng, words, 4000))), (4, "go " * 100_000), (5, "go " * 5)]
    assert len(shingle_set(rows[0][1].encode().split(), 5)) > 140_000
    assert result(spark, rows) == brute(rows)


def test_query_agrees_with_its_sql(spark, tmp_path):
    rows = [(i, t) for i, t in corpus(3) if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op11_minhash"])
    got = queries.op11_minhash(spark, str(tmp_path))
    assert [c[0] for c in want.description] == got.columns
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in got.collect())
