import random

import numpy as np
import xxhash

from feedlens.llm import simhash
from feedlens.llm.components import components

SCHEMA = "doc_id long, text string, fingerprint string"


def brute_print(text, words=3):
    own = (text or "").encode().lower().split()
    runs = [b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(ids, linked):
    root = {i: i for i in ids}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = []
    for n in range(60):
        rows.append((n, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 40, 200])))))
    for n in range(60, 120):
        words = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        rows.append((n, " ".join(words).upper() if n % 4 == 0 else "  ".join(words)))
    return rows + [(200, None), (201, ""), (202, "\t \n"), (203, "É é")]


def test_matches_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(*r, "clash") for r in rows + [rows[3]]], SCHEMA)
    for tile in (2048, 3):
        got = simhash.simhash_components(df, tile=tile).collect()
        assert len(got) == len(rows) + 1
        prints = {i: brute_print(t) for i, t in rows}
        linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
        want = groups(prints, linked)
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_null_ids_and_empty_table(spark):
    got = simhash.simhash_components(spark.createDataFrame([(None, "a b c d", "x"), (4, "A b c d", "x"), (None, "other", "x")], SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]
    assert not simhash.simhash_components(spark.createDataFrame([], SCHEMA)).collect()


def test_near_copies_match_brute_force(spark):
    rng = random.Random(9)
    rows = texts(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows += [(300 + n, " ".join(base[:k] + ["x"] + base[k + 1 :])) for n, k in enumerate(range(0, 120, 3))]
    df = spark.createDataFrame([(*r, "clash") for r in rows + [(None, "a b c"), rows[5]]], SCHEMA)
    linked = [(a, b) for a, x in rows for b, y in rows if a < b and simhash.jaccard(x, y, 5) >= 0.8]
    for more in ({}, {"tile": 5, "family_tile": 3}):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df, **more).collect()}
        assert got == groups([i for i, _ in rows], linked)


def test_near_copies_with_repeated_shingles(spark):
    rng = random.Random(12)
    base, line = [f"w{rng.randrange(5000)}" for _ in range(200)], [f"v{n}" for n in range(12)]
    rows = [(1, " ".join(base)), (2, " ".join(base * 2)), (3, " ".join(line * 10 + base[::-1])), (4, " ".join(line * 100 + base[::-1])), (5, "other words that are here alone")]
    assert min(simhash.jaccard(rows[0][1], rows[1][1], 5), simhash.jaccard(rows[2][1], rows[3][1], 5)) > 0.9
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_near_copies_beyond_the_radius(spark):
    rng, rows = random.Random(13), []
    while len(rows) < 6:
        base = [f"w{rng.randrange(5000)}" for _ in range(230)]
        other = [x if n % 50 != 25 else "edit" for n, x in enumerate(base)]
        one, two = " ".join(base), " ".join(other)
        if simhash.jaccard(one, two, 5) >= 0.8 and ((simhash.fingerprint(one, 5) ^ simhash.fingerprint(two, 5)) & (1 << 64) - 1).bit_count() > 14:
            rows += [(len(rows), one), (len(rows) + 1, two)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: n - n % 2 for n in range(6)}


def test_components_of_a_path_and_of_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 140)] + [(5, 5), (None, 3)]
    for chunk in (250_000, 16):
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), chunk=chunk).collect()}
        assert got == {i: 0 for i in range(51)} | {x: 100 for x in range(100, 140)}
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def test_spanning_pairs_span():
    rng = np.random.default_rng(0)
    i, j = rng.integers(0, 50, 80), rng.integers(0, 50, 80)
    a, b = simhash.spanning_pairs(50, i, j, rng.integers(0, 5, 80))
    assert np.array_equal(simhash.forest(50, a, b), simhash.forest(50, i, j)) and len(a) == 50 - len(set(simhash.forest(50, i, j)))


def test_near_copies_of_small_texts_are_all_found(spark):
    rng, rows = random.Random(31), []
    for n in range(3000):
        size = rng.randint(8, 15)
        words = [f"w{rng.randrange(50_000)}" for _ in range(size)]
        rows += [(2 * n, words), (2 * n + 1, words[:-1] if n % 2 else ["new", *words])]
    linked = [(a, a + 1) for a in range(0, 6000, 2) if simhash.jaccard(" ".join(rows[a][1]), " ".join(rows[a + 1][1]), 5) >= 0.8]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    assert len(linked) > 2500 and got == groups(range(6000), linked)


def test_small_links_match_brute_force(spark):
    rng = random.Random(32)
    base = [f"w{k}" for k in range(16)]
    rows = []
    for n in range(300):
        words = base[rng.randrange(3) : 16 - rng.randrange(4)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(3)}"
        rows.append((n, " ".join(words[: rng.randint(1, 16)])))
    for similarity in (0.8, 0.7, 1.0):
        sets = {i: set(simhash.shingle_set(t.encode().split(), 5).tolist()) for i, t in rows}
        small = [i for i in sets if len(sets[i]) <= simhash.SMALL_SET]
        linked = [(a, b) for a in small for b in small if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
        found = simhash.small_links(spark.createDataFrame([(i, t) for i, t in rows] + [(900, ""), (901, " ")], "node long, text string"), 5, similarity)
        assert groups(sets, [tuple(r) for r in found.collect()]) == groups(sets, linked)
