import random

from feedlens.llm.chat import link_quotations, parse

SCHEMA = "conv_id long, turn long, role string, text string, position string"


def run(spark, rows):
    got = link_quotations(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    return {(r["conv_id"], r["turn"]): r for r in got}, got


def test_links_threads_and_order(spark):
    rows = [
        (1, 0, "user", "How do I bake bread?\nI have flour."), (1, 1, "assistant", "Mix flour and water.\n\nThen bake it."), (1, 2, "user", "An unrelated question about cats"),
        (1, 3, "user", "On Monday the assistant wrote:\n> Then   BAKE it.\n\nFor how long?"), (1, 4, "assistant", "> An unrelated question\n> about cats\nCats are fine."),
        (1, 5, "user", "> For how long?\n>> Then bake it.\nAnyone?"), (2, 0, "user", "> For how long?\nnot in this conversation"), (1, None, "user", "late"), (None, 0, "user", None), (1, 2, "user", "An unrelated question about cats"),
    ]
    by, got = run(spark, rows)
    assert len(got) == len(rows)
    assert [(by[1, t]["reply_to"], by[1, t]["thread"]) for t in (0, 1, 3, 4, 5)] == [(None, 0), (None, 1), (1, 1), (2, 2), (3, 1)]
    assert by[1, 3]["text"] == "For how long?" and by[1, 5]["text"] == "Anyone?" and by[1, 5]["quote_depth"] == 2
    assert by[2, 0]["reply_to"] is None and by[None, 0]["text"] == ""
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])]
    assert order == [0, 1, 3, 5, 2, 2, 4, None]
    assert sorted(r["position"] for r in got if r["conv_id"] == 1) == list(range(8))


def test_long_reply_chain_and_empty_table(spark):
    rows = [(7, 0, "user", "line 0 of many words")] + [(7, n, "user", f"> line {n - 1} of many words\nline {n} of many words") for n in range(1, 40)]
    by, _ = run(spark, rows)
    assert all(by[7, n]["reply_to"] == n - 1 and by[7, n]["thread"] == 0 and by[7, n]["position"] == n for n in range(1, 40))
    assert run(spark, [])[1] == []


def test_nested_levels():
    own, depth, said, quoted = parse("> > deep\n> mid\nown")
    assert (own, depth) == ("own", 2) and {q[0] for q in quoted} == {1, 2} and len(said) == 1
    assert {(q[0], q[3], q[5]) for q in parse("> a b\n> c\n>\n> d")[3]} == {(1, 0, 4), (1, 1, 3), (1, 1, 1), (1, 2, 2), (1, 2, 1)}
    assert parse(None) == ("", 0, set(), set())


def norm(lines):
    return " ".join(" ".join(lines).lower().split())


def units(lines):
    """The block, its paragraphs with their lines."""
    parts, part = [], []
    for line in [*lines, ""]:
        if line.strip():
            part.append(line)
        elif part:
            parts.append(part)
            part = []
    return norm(lines), [(norm(p), [norm([x]) for x in p]) for p in parts]


def split(text):
    blocks = []
    for line in text.split("\n"):
        level = 0
        while line.startswith("> ") or line == ">":
            level, line = level + 1, line[2:]
        if not blocks or blocks[-1][0] != level:
            blocks.append((level, []))
        blocks[-1][1].append(line)
    return blocks


def brute_parent(messages, turn):
    """The turn that a message replies to, by looking at all earlier messages for all it quotes."""
    first = {}
    for t, text in sorted(messages, key=lambda x: -x[0]):
        own = []
        for level, lines in split(text):
            if not level:
                own += lines
                whole, parts = units(lines)
                for said in [whole, *(p for p, _ in parts), *(x for _, ls in parts for x in ls)]:
                    first[said] = t
        first[norm(own)] = t
    counted = set()
    for text in (x for t, x in messages if t == turn):
        for level, lines in split(text):
            if not level:
                continue
            whole, parts = units(lines)
            ok = lambda x: x and first.get(x, turn) < turn
            for got in [whole] if ok(whole) else [y for p, ls in parts for y in ([p] if ok(p) else [x for x in ls if ok(x)])]:
                counted.add((level, got))
    weight = {}
    for level, got in counted:
        n, least = weight.get(first[got], (0, 99))
        weight[first[got]] = n + len(got.split()), min(least, level)
    return min(weight, key=lambda t: (-weight[t][0], weight[t][1], t)) if weight else None


def test_matches_brute_force(spark):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    talks, rows = {}, []
    for conv in range(25):
        talks[conv] = []
        for turn in range(12):
            parts = ["\n".join(line() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 2))]
            text = "\n\n".join(parts)
            for _ in range(rng.randint(0, 3)):
                if talks[conv]:
                    level = rng.randint(1, 2)
                    own = "\n".join(x for n, ls in split(rng.choice(talks[conv])[1]) if not n for x in ls).split("\n")
                    i = rng.randint(0, len(own) - 1)
                    quoted = own[i : rng.randint(i + 1, len(own))] if rng.random() < 0.6 else own
                    text = "\n".join("> " * level + x for x in quoted) + "\n" + text
            talks[conv].append((turn, text))
            rows.append((conv, turn, "user", text))
        if conv % 5 == 0:
            talks[conv].append((7, line()))
            rows.append((conv, 7, "tool", talks[conv][-1][1]))
    # one word quoted at the outermost level against seven at the next
    talks[90] = [(0, "yes"), (1, "one two three four five six seven"), (2, "> yes\n> > one two three four five six seven\nfine")]
    rows += [(90, t, "user", x) for t, x in talks[90]]
    long = "\n".join(line() for _ in range(20_000))
    talks[91] = [(0, long), (1, "> " + long.replace("\n", "\n> ") + "\nquite")]
    rows += [(91, t, "user", x) for t, x in talks[91]]
    by, _ = run(spark, rows)
    for conv, messages in talks.items():
        for turn in {t for t, _ in messages}:
            assert by[conv, turn]["reply_to"] == brute_parent(messages, turn), (conv, turn)
    assert by[90, 2]["reply_to"] == 1 and by[91, 1]["reply_to"] == 0
    assert sum(r["reply_to"] is not None for r in by.values()) > 100
