import random

import numpy as np

from feedlens.llm import substrings as sub


def brute_windows(h, least):
    """Cartesian tree by recursion; of equal hashes the leftmost is least."""
    out, todo = set(), [(0, len(h) - 1)]
    while todo:
        l, r = todo.pop()
        if r - l + 1 < least:
            continue
        c = l + int(np.argmin(h[l : r + 1]))
        out.add((c, l, r))
        todo += [(l, c - 1), (c + 1, r)]
    return out


def test_compact_windows_match_the_recursive_tree():
    rng = np.random.default_rng(0)
    for n in (0, 1, 4, 5, 30, 200):
        for least in (1, 2, 5, 7):
            h = rng.integers(0, 1 << 63, n).astype(np.uint64) & ~np.uint64(0xFFFF)
            c, l, r = sub.compact_windows(h, np.zeros(n, int), least)
            assert set(zip(c.tolist(), l.tolist(), r.tolist())) == brute_windows(h, least)


def test_windows_stay_inside_documents():
    rng = np.random.default_rng(2)
    h = (rng.integers(0, 1 << 63, 60).astype(np.uint64)) & ~np.uint64(0xFFFF)
    doc = np.repeat([0, 1, 2], [20, 3, 37])
    got = set(zip(*(x.tolist() for x in sub.compact_windows(h, doc, 5))))
    want = brute_windows(h[:20], 5) | {(c + 23, l + 23, r + 23) for c, l, r in brute_windows(h[23:], 5)}
    assert got == want


def words(rng, n):
    return [f"{rng.choice('abcdefghij')}{rng.randint(0, 400)}" for _ in range(n)]


def corpus():
    rng = random.Random(4)
    passage, other = words(rng, 60), words(rng, 80)
    near = list(other)
    near[40] = "changed"
    rows = [(n, words(rng, 100)) for n in range(30)]
    for n in (3, 8, 9, 20):
        rows[n] = (n, rows[n][1][:30] + passage + rows[n][1][30:])
    rows[5], rows[12] = (5, rows[5][1] + other), (12, near + rows[12][1])
    rows = [(n, " ".join(w).upper() if n == 9 else " ".join(w)) for n, w in rows]
    return rows + [(100, None), (101, ""), (102, "few words"), (None, " ".join(passage)), (3, rows[3][1])]


def test_finds_shared_passages_and_leaves_the_rest(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    got = sub.near_passages(docs).collect()
    assert {r["doc_id"] for r in got} == {8, 9, 20, 12}
    for r in got:
        assert r["other_doc_id"] < r["doc_id"] and r["jaccard"] >= 0.8
        if r["doc_id"] in (8, 9, 20):
            assert (r["start"], r["end"]) == (30, 90)
        else:
            assert r["end"] - r["start"] >= 78
    kept = sub.cut_passages(docs, sub.near_passages(docs)).collect()
    assert len(kept) == len(rows)
    text = {r["doc_id"]: r["text"] for r in kept if r["doc_id"] not in (3, None)}
    assert len(text[8].split()) == 100 and text[0] == dict(rows)[0] and text[100] is None
    assert kept[0].asDict().keys() == {"doc_id", "text", "start"}


def test_whole_copies_go_and_one_is_kept(spark):
    text = " ".join(words(random.Random(1), 200))
    docs = spark.createDataFrame([(n, text) for n in range(40)] + [(77, "short")], "doc_id long, text string")
    found = sub.near_passages(docs)
    assert {r["doc_id"] for r in found.collect()} == set(range(1, 40))
    assert {r["doc_id"] for r in sub.cut_passages(docs, found).collect()} == {0, 77}


def test_exact_repeats_behind_a_variant_or_a_common_line(spark):
    rng = random.Random(11)
    line, rows, want = words(rng, 18), [], set()
    for n in range(60):
        passage = words(rng, 34) + line if n % 2 else words(rng, 56)
        first = line if n % 2 else [x if k % 16 else f"y{n}" for k, x in enumerate(passage)]
        for k, part in enumerate((first, passage, passage)):
            rows.append((k * 100 + n, " ".join(words(rng, 60) + part + words(rng, 60))))
        want.add(200 + n)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sub.near_passages(docs).collect()
    for n in want:
        size = 52 if n % 2 else 56
        for i in range(60, 60 + size - 49):
            assert any(r["doc_id"] == n and r["start"] <= i and r["end"] >= i + 50 and r["other_doc_id"] == n - 100 for r in got), (n, i)
    text = dict(rows)
    for r in got:
        if r["jaccard"] == 1.0:
            one, two = text[r["doc_id"]].split(), text[r["other_doc_id"]].split()
            assert one[r["start"] : r["end"]] == two[r["other_start"] : r["other_end"]]


def brute_windows_of(texts, size=50):
    """For each document, the starts of its windows of `size` words that a document with a smaller id has."""
    seen, out = {}, {}
    for doc, text in sorted(texts.items()):
        w = text.lower().split()
        own = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        out[doc] = {i for i, x in enumerate(own) if x in seen}
        for x in own:
            seen.setdefault(x, doc)
    return out


def triples():
    """Pairs that share 60 words, behind a third document, first by id, that quotes 44 of them; every third pair is a near-duplicate."""
    rng, rows, near = random.Random(21), [], set()
    for n in range(150):
        passage = words(rng, 60)
        at = rng.randint(0, 16)
        other = list(passage)
        if n % 3 == 0:
            other[rng.randint(5, 55)] = "changed"
            near.add(n)
        for k, part in enumerate((passage[at : at + 44], passage, other)):
            rows.append((k * 1000 + n, " ".join(words(rng, rng.randint(30, 90)) + part + words(rng, rng.randint(30, 90)))))
    return rows, near


def test_pairs_behind_a_partial_quote_are_found_alike_for_any_partitions(spark):
    rows, near = triples()
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(tuple(r) for r in sub.near_passages(docs.repartition(n)).collect()) for n in (1, 8, 64)]
    assert got[0] == got[1] == got[2]
    pairs = {(r[0], r[3]) for r in got[0]}
    exact = [n for n in range(150) if n not in near]
    assert all((2000 + n, 1000 + n) in pairs for n in exact)
    assert sum((2000 + n, 1000 + n) in pairs for n in near) >= 0.9 * len(near)
    assert all(a % 1000 == b % 1000 and a >= 2000 for a, b in pairs)


def test_every_repeated_window_lies_in_a_passage_and_passages_are_alike(spark):
    rng, texts = random.Random(8), {}
    pool = [words(rng, rng.randint(40, 120)) for _ in range(12)]
    for n in range(80):
        parts = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(pool)
            i = rng.randint(0, 20)
            parts += words(rng, rng.randint(0, 40)) + part[i : rng.randint(i + 20, len(part))]
        texts[n] = " ".join(parts)
    texts[80] = " ".join(words(rng, 3) * 40)  # repeats inside one text
    texts[81] = texts[80]
    texts[82] = " ".join(w for _ in range(300) for w in words(rng, 60)) + " " + texts[0]  # very long
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = sub.near_passages(docs).collect()
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
        one, two = texts[r["doc_id"]].lower().split()[r["start"] : r["end"]], texts[r["other_doc_id"]].lower().split()[r["other_start"] : r["other_end"]]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, two))
        assert len(x & y) >= 0.8 * len(x | y) and r["end"] - r["start"] >= 50
    for doc, starts in brute_windows_of(texts).items():
        for i in starts:
            assert any(s <= i and i + 50 <= e for s, e in spans.get(doc, ())), (doc, i)


def test_seed_lengths():
    assert sub.seed_places(46, 0.8) == 20 and sub.seed_places(46, 1.0) == 46
    assert sub.seed_places(46, 0.5) < 20


def test_rows_that_share_an_id(spark):
    rng = random.Random(5)
    one, two = " ".join(words(rng, 80)), " ".join(words(rng, 80))
    least, most = sorted((one, two))
    docs = spark.createDataFrame([(1, least), (2, least), (2, most), (2, most), (3, most), (None, most)], "doc_id long, text string")
    found = sub.near_passages(docs)
    assert [(r["doc_id"], r["other_doc_id"]) for r in found.collect()] == [(2, 1)]
    kept = sub.cut_passages(docs, found)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, least), (2, most), (2, most), (3, most), (0, most)])


def test_empty_table(spark):
    assert not sub.near_passages(spark.createDataFrame([], "doc_id long, text string")).collect()


def test_without_words_keeps_what_is_around():
    assert sub.without_words("a  b\nc d", [(1, 3)]) == "a  d"
    assert sub.without_words("a b c", [(0, 2), (1, 3)]) == ""
    assert sub.without_words("a b", [(5, 9)]) == "a b"


def test_near_duplicates_behind_two_partial_quotes(spark):
    rng, rows = random.Random(21), []
    for n in range(100):
        one = [f"w{rng.randrange(100_000)}" for _ in range(52)]
        two = [*one[:26], "changed", *one[27:]]
        pad = lambda: [f"p{rng.randrange(100_000)}" for _ in range(30)]
        rows += [(4 * n, pad() + one[:26] + pad()), (4 * n + 1, pad() + one[-25:] + pad()), (4 * n + 2, pad() + one + pad()), (4 * n + 3, pad() + two + pad())]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r["doc_id"], r["other_doc_id"]) for r in sub.near_passages(docs).collect()}
    assert got <= {(4 * n + 3, 4 * n + 2) for n in range(100)} and len(got) >= 95


def test_exact_repeats_beside_near_duplicates(spark):
    """Windows whose first holder repeats an earlier document nearly, and is held by that."""
    rng, rows = random.Random(22), []
    word = lambda: f"w{rng.randrange(100_000)}"
    for n in range(40):
        base = [word() for _ in range(140)]
        middle = [*base[:60], word(), *base[61:]]
        cut = rng.randrange(5, 85)
        last = [*[word() for _ in range(20)], *middle[cut : cut + 52], *[word() for _ in range(20)], *base[80:130]]
        rows += [(3 * n, base), (3 * n + 1, middle), (3 * n + 2, last)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {}
    for r in sub.near_passages(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    seen, missed = set(), 0
    for i, w in rows:
        windows = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        missed += sum(x in seen and not any(s <= k and k + 50 <= e for s, e in found.get(i, ())) for k, x in enumerate(windows))
        seen |= set(windows)
    assert missed == 0
