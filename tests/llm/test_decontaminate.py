import random

from feedlens.llm.decontaminate import Screen, align, find_benchmark, folded


def distance(item: bytes, text: bytes) -> int:
    """Least edits of item against any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        up, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(up[j - 1] + (a != b), up[j] + 1, row[-1] + 1))
    return min(row)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_matches_brute_force(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, 12)) for i in range(6)] + [(90, None), (91, ""), (92, "ab"), (0, sentence(rng, 12))]
    docs = []
    for n in range(40):
        text = sentence(rng, 60)
        if n % 3 == 0:
            item = items[n % 6][1]
            edited = "".join(c for c in item if rng.random() > 0.05 * (n % 4))
            text = text[:90] + " " + edited.upper().replace(" ", ",  ") + " " + text[90:]
        docs.append((n, text, "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, items[1][1], "x"), (None, items[2][1], "x"), (3, docs[3][1], "x")]
    got = find_benchmark(spark.createDataFrame(docs, "doc_id long, text string, n_edits string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for d, text, _ in docs:
        for i, item in items:
            a, b = folded(item), folded(text)
            k = min(int(0.12 * len(a)), (len(a) - 7) // 7)
            if len(a) >= 7 and b and (n := distance(a, b)) <= k:
                want.add((d, i, n))
    assert {(r["doc_id"], r["item_id"], r["n_edits"]) for r in got} == want
    assert len({d for d, _, _ in want}) > 8
    assert sum(r["doc_id"] == 3 for r in got) == 2 * sum(d == 3 for d, _, _ in want)  # repeated rows


def test_copies_in_neighbouring_texts_beside_a_long_item(spark):
    rng = random.Random(8)
    item = sentence(rng, 30)
    items = spark.createDataFrame([(1, item), (2, sentence(rng, 900))], "item_id long, text string")
    docs = spark.createDataFrame([(n, item) for n in range(50)], "doc_id long, text string").coalesce(1)
    got = find_benchmark(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_edits"]) for r in got) == [(n, 1, 0) for n in range(50)]


def test_common_grams_and_a_very_long_text_match_brute_force(spark):
    """Most items share a template, so most of their q-grams are in most items; and a text of several pieces."""
    rng = random.Random(17)
    items = [(i, f"what is the name of the capital city of {sentence(rng, 1 + i % 3)} {i}") for i in range(120)]
    docs = []
    for n in range(30):
        text = sentence(rng, 40) + " " + items[n * 4][1]
        docs.append((n, text if n % 2 else text.replace("capital", "capitol")))
    docs.append((100, "what is the name of the capital city of nowhere at all"))
    got = find_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for d, text in docs:
        for i, item in items:
            a = folded(item)
            k = min(int(0.12 * len(a)), (len(a) - 7) // 7)
            if (n := distance(a, folded(text))) <= k:
                want.add((d, i, n))
    assert len(want) > 30 and {(r["doc_id"], r["item_id"], r["n_edits"]) for r in got} == want
    screen = Screen([(i, x) for i, x in items], common=64)
    assert (screen.bound < screen.sizes - 6 - 7 * screen.edits).any() or screen.count.max() > 64
    filler = sentence(rng, 30_000).encode()
    long = filler[:50_000] + b" " + folded(items[5][1]) + b" " + filler[50_000:] + b" " + folded(items[7][1])
    found = {(i, n, start) for _, i, n, _, start, _ in screen.search([b"short", long], piece=10_000)}
    assert {(5, 0, 50_001), (7, 0, len(long) - len(folded(items[7][1])))} <= found


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert not find_benchmark(docs, items).collect()
    assert not find_benchmark(spark.createDataFrame([(1, "some text here")], "doc_id long, text string"), items).collect()


def test_alignment_has_its_place():
    import numpy as np

    at = lambda s: np.frombuffer(s, np.uint8)
    assert align(at(b"hello world"), at(b"xx helo world yy"), 3) == (1, 3, 13)
    assert align(at(b"hello"), at(b"zzzzzzzz"), 2) is None


def test_blocks_give_what_one_block_gives(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, 12)) for i in range(9)]
    docs = [(n, sentence(rng, 30) + " " + items[n % 9][1] if n % 2 else sentence(rng, 40)) for n in range(30)]
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, find_benchmark(frame, benchmark, block_chars=n).collect())) for n in (1 << 22, 100))
    assert one == many and len(one) >= 15


def test_texts_that_share_q_grams_but_no_band():
    rng = random.Random(9)
    item = sentence(rng, 12)
    parts = [item[k : k + 12] for k in range(0, len(item) - 12, 12)]
    for n in range(40):
        rng.shuffle(parts)
        text = folded((" " + sentence(rng, 60) + " ").join(parts))
        assert all(edits > 0 for _, _, edits, *_ in Screen([(1, item)], 7, 0.12).search([text]))
