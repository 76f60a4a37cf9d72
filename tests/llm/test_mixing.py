import hashlib
import random

from pyspark.sql import functions as F

from feedlens.llm.mixing import mix

WEIGHTS = {"domain": {"a": 3}, "lang": {"en": 2}}
SCHEMA = "doc_id long, text string, domain string, lang string, source string, tokens string"


def share(children, budget):
    """children: name -> (weight, cap). Water-filling in whole numbers, the fullest first."""
    given, left = {}, budget
    todo = sorted(children, key=lambda c: (children[c][1] / children[c][0], children[c][1], c is not None, c or ""))
    while todo:
        w, cap = children[todo[0]]
        rest = sum(children[c][0] for c in todo)
        if cap * rest > left * w:
            return given | {c: min(children[c][1], left * children[c][0] // rest) for c in todo}
        given[todo.pop(0)] = cap
        left -= cap
    return given


def brute(rows, part=0.6, epochs=3, seed="mix-1"):
    n = [len((t or "").split()) for _, t, *_ in rows]
    def down(at, depth, budget):
        if depth == 3:
            return {at: budget}
        kids = {}
        for r, k in zip(rows, n):
            if tuple(r[2 : 2 + depth]) == at:
                name = r[2 + depth]
                w = WEIGHTS.get(("domain", "lang", "source")[depth], {}).get(name, 1)
                kids[name] = w, kids.get(name, (w, 0))[1] + k * epochs
        out = {}
        for name, given in share(kids, budget).items():
            out |= down((*at, name), depth + 1, given)
        return out
    budget = down((), 0, min(int(sum(n) * part), sum(n) * epochs))
    out = []
    for leaf, given in budget.items():
        own = [(r[0], k) for r, k in zip(rows, n) if tuple(r[2:5]) == leaf]
        total = sum(k for _, k in own)
        whole, rest = divmod(given, total) if total else (0, 0)
        key = lambda x: (hashlib.md5(f"{seed}-{whole}-{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] is not None, x[0] or 0, x[1])
        for i, k in sorted(own, key=key):
            taken = max(0, min(k, rest))
            rest -= k
            out.append((i, k, whole if k else 0, taken))
    return sorted(out, key=str)


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = rng.random() < 0.4
        out.append((i, " ".join("w" for _ in range(rng.randint(0, 30))), "a" if hot else rng.choice("abc"), "en" if hot else rng.choice(["en", "fr", None]), "s0" if hot else rng.choice(["s1", "s2", None])))
    return out


def test_matches_brute_force(spark):
    data = rows(300, 1) + [(None, "a b c", "b", "fr", "s1"), (900, None, "d", "en", "s9"), (901, "", "d", "en", "s9"), (7, "a b", "a", "en", "s0"), (7, "a b", "a", "en", "s0"), (902, "one", "lonely", "en", "s1")]
    df = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)
    levels = {c: F.col(c) for c in ("domain", "lang", "source")}
    got = [(r["doc_id"], r["n_tokens"], r["epochs"], r["part_tokens"]) for r in mix(df, levels, WEIGHTS).collect()]
    assert sorted(got, key=str) == brute(data)


def test_empty_table(spark):
    levels = {c: F.col(c) for c in ("domain", "lang", "source")}
    assert not mix(spark.createDataFrame([], SCHEMA), levels, WEIGHTS).collect()
