import random
import re
from collections import Counter

import duckdb

from feedlens.llm import collocations as col
from feedlens.llm import queries


def brute(rows, longest=4, least=30, contained=80, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= contained * a for q, b in found.items())
            if not inside:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "city", "hall", "of", "the", "é", "ÉT", "𝔸", "ﬀ", "x\x0by"]
    rows = []
    for n in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if n % 2:
            words += ["new", "york", "city"] * 2
        rows.append(("".join(w + rng.choice((" ", "  ", "\t", ". ", ",", "\n", " ", " ")) for w in words), rng.choice(("en", "en", "fr", None, "und"))))
    return rows + [(None, "en"), ("", "de"), (" .,; ", "de"), rows[3], rows[3]]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, phrase string")
    for options in ({}, {"least": 3, "top": 7}, {"longest": 3, "least": 5, "contained": 50}):
        got = col.collocations(docs, **options)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, **options)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]


def test_chunks_add_up(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abcdef") for _ in range(n)), "en") for n in (1, 2, 3, 9, 10, 11, 12, 13, 14, 57, 400)]
    monkeypatch.setattr(col, "CHUNK", 10)
    got = col.collocations(spark.createDataFrame(rows, "text string, lang string"), least=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least=2)


def test_empty_table_and_large_numbers(spark):
    assert not col.collocations(spark.createDataFrame([], "text string, lang string")).collect()
    a, l = 6_000_000_000_000_000_001, 9_000_000_000_000_000_007
    cut = "(cast(2000000 as decimal(18, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(l as decimal(20, 0)))"
    assert spark.sql(f"SELECT {cut} FROM VALUES ({a}L, {l}L) t(a, l)").first()[0] == 2_000_000 * a // (2 * l)


def test_query_agrees_with_its_sql(spark, tmp_path):
    docs = spark.createDataFrame([(n, *r) for n, r in enumerate(corpus(4))], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect()
    want.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op12_collocations(spark, str(tmp_path))
    rows = want.execute(queries.oracle_sql()["op12_collocations"])
    assert [c[0] for c in rows.description] == got.columns
    assert sorted(rows.fetchall()) == sorted(tuple(r) for r in got.collect()) != []
