import hashlib
import random
import zlib

from feedlens.llm import queries, runs


def brute_runs(words, least=12):
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p - i), p)  # periods grow, so the first is the smallest
            i = j + 1
    # A stretch counts under its smallest period only.
    return sorted((s, length, p) for (s, length), p in out.items() if not any(q < p and all(words[k] == words[k + q] for k in range(s, s + length - q)) for q in range(1, p)))


def sequences(seed=3):
    rng = random.Random(seed)
    for _ in range(600):
        yield [rng.choice("ab" if rng.random() < 0.5 else "abcd") for _ in range(rng.randint(0, 60))]
    for _ in range(150):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        yield [rng.choice("abc") for _ in range(rng.randint(0, 20))] + (unit * 40)[: rng.randint(1, 90)] + [rng.choice("abc") for _ in range(rng.randint(0, 20))]
    a, b = ["a"], ["a", "b"]
    for _ in range(7):
        a, b = b, b + a
    yield b  # Fibonacci words have many runs
    thue = [0]
    for _ in range(7):
        thue += [1 - x for x in thue]
    yield thue
    yield ["x"] * 100


def test_runs_match_brute_force():
    for words in sequences():
        for least in (2, 12):
            assert runs.periodic_runs(words, least) == brute_runs(words, least), words


def test_colliding_hashes_are_caught(monkeypatch):
    monkeypatch.setattr(runs, "PRIME", 5)
    for words in list(sequences())[600:660]:
        for s, length, p in runs.periodic_runs(words):
            assert length >= max(12, 2 * p) and all(words[k] == words[k + p] for k in range(s, s + length - p))


def test_lyndon_lengths_are_those_of_the_longest_lyndon_words():
    rng = random.Random(1)
    lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
    for _ in range(100):
        ids = [rng.randrange(3) for _ in range(25)]
        after, _ = runs.extents(ids)
        assert runs.lyndon_lengths(ids, after) == [max(k for k in range(1, 26 - i) if lyndon(ids[i : i + k])) for i in range(25)]


def test_collapsed_words():
    for words in sequences(8):
        found = brute_runs(words)
        gone = {k for s, length, p in found for k in range(s + p, s + length)}
        assert runs.collapsed_words(words, found) == [w for k, w in enumerate(words) if k not in gone]


def test_edge_rows_and_a_very_long_text(spark):
    unit = " ".join(f"w{k}" for k in range(700))
    rows = [(1, None, "x"), (2, "", "x"), (None, " \t\n", "x"), (3, "go " * 200_000, "x"), (3, "go " * 12, "x"), (4, f"É  Go {unit} {unit} {unit} end", "x"), (5, "Go go " * 5 + "Go", "x")]
    got = runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    assert [(r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"][:9]) for r in got] == [
        (1, 0, [], ""), (2, 0, [], ""), (None, 0, [], ""), (3, 200_000, [(0, 200_000, 1)], "go"), (3, 12, [(0, 12, 1)], "go"), (4, 2103, [(2, 2100, 700)], "É Go w0 w"), (5, 11, [], "Go go Go "),
    ]
    assert not runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect()


def test_query_matches_the_contract(spark, tmp_path):
    rng = random.Random(6)
    rows = [(n, " ".join(rng.choice(("a", "b", "It", "é")) for _ in range(rng.choice([0, 1, 5, 40, 150]))) or None) for n in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for doc, text in rows:
        own = (text or "").split()
        h, n = zlib.crc32(str(doc).encode()), len(own)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
        found = brute_runs(own)
        best = min(((-length, s, p) for s, length, p in found), default=None)
        gone = {k for s, length, p in found for k in range(s + p, s + length)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[doc] = (len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for k, w in enumerate(own) if k not in gone)))
    got = queries.op13_runs(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and sum(v[0] > 0 for v in want.values()) > 8
