"""Toxicity by a lexicon trie met by Levenshtein automata, with context windows that tell quotation from abuse.

The lexicon is learned from a bounded sample of labelled documents, besides a few seed words: whole words, and stems
that inflected words share. The trie and the automata of edit distance 1 are intersected into one automaton whose
states are made as words reach them. A logistic model over a document's hits, as abuse and as quotation, is fitted on
the same sample.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from feedlens.llm.common import bucket_of, cut

SEED_WORDS = ("idiot", "imbecile", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "jerk", "bastard")
REPORTING = frozenset("said says wrote writes called quoted quote says dit écrit appelé sagte schrieb nannte dijo escribió llamó".split())
ADDRESS = frozenset("you your you're u tu toi vous votre du dich dir dein sie ihr usted tú ustedes te".split())
QUOTES = "\"“”«»„‟"
TOKEN = re.compile(rf"[{QUOTES}]|\w+", re.UNICODE)
END, STEM = "$", "*"


class Lexicon:
    """Words (ending in $) and stems (ending in *) in a trie; match() walks trie and automaton together.

    A state is a set of (node, edits): all trie nodes that some reading of the characters so far, with that many
    edits, reaches. Words of at least `fuzzy_from` characters may be one edit away, shorter ones and short stems none.
    """

    def __init__(self, terms: list[str], fuzzy_from: int = 5, stem_fuzzy_from: int = 7):
        self.terms, self.fuzzy_from, self.stem_fuzzy_from = terms, fuzzy_from, stem_fuzzy_from
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        for n, term in enumerate(terms):
            node = 0
            for ch in term[:-1]:
                node = self.children[node].setdefault(ch, len(self.children))
                if node == len(self.children):
                    self.children.append({})
            (self.word_at if term[-1] == END else self.stem_at)[node] = n
        self.start = self._closed({(0, 0)})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.ends: dict[frozenset, tuple[int, int] | None] = {}
        self.known: dict[str, tuple[int, int] | None] = {}

    def _allowed(self, term: int) -> int:
        return int(len(self.terms[term]) - 1 >= (self.fuzzy_from if self.terms[term][-1] == END else self.stem_fuzzy_from))

    def _closed(self, state: set[tuple[int, int]]) -> frozenset:
        """With the readings in which the word left out a character of the term."""
        more = {(child, 1) for node, edits in state if edits == 0 for child in self.children[node].values()}
        return frozenset(state | more)

    def _step(self, state: frozenset, ch: str) -> frozenset:
        key = (state, ch)
        if (found := self.steps.get(key)) is not None:
            return found
        to: set[tuple[int, int]] = set()
        for node, edits in state:
            if (child := self.children[node].get(ch)) is not None:
                to.add((child, edits))
            if edits == 0:
                to.add((node, 1))
                to.update((other, 1) for other in self.children[node].values())
        if len(self.steps) > 50_000:
            self.steps.clear()
        out = self.steps[key] = self._closed(to)
        return out

    def _best(self, state: frozenset, at: dict[int, int]) -> tuple[int, int] | None:
        found = [(edits, at[node]) for node, edits in state if node in at and edits <= self._allowed(at[node])]
        if not found:
            return None
        edits, term = min(found)
        return term, edits

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the closest term, or None. A stem matches where the word begins with it."""
        if word in self.known:
            return self.known[word]
        state, best = self.start, None
        for ch in word:
            state = self._step(state, ch)
            if not state:
                break
            if self.stem_at and (stem := self._best(state, self.stem_at)) and (best is None or stem[1] < best[1]):
                best = stem
        else:
            if (whole := self._best(state, self.word_at)) and (best is None or whole[1] <= best[1]):
                best = whole
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = best
        return best


N_FEATURES = 7


def features(text: str | None, lexicon: Lexicon, window: int = 6) -> np.ndarray:
    """Counts of hits in a text: exact, misspelled, stems; quoted ones apart; and how near the reader is addressed."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    tokens = TOKEN.findall(text.lower())
    match = lexicon.match
    hits = [(i, m) for i, m in enumerate(map(match, tokens)) if m]
    if not hits:
        return out
    marks = np.fromiter((t in QUOTES for t in tokens), bool, len(tokens)) if any(q in text for q in QUOTES) else None
    weight = 0.0
    for i, (term, edits) in hits:
        near = tokens[max(0, i - window) : i + window + 1]
        quoted = marks is not None and marks[max(0, i - window) : i].sum() % 2 == 1 and marks[i + 1 : i + 1 + window].any()
        quoted = quoted or any(t in REPORTING for t in near)
        if quoted:
            out[3] += 1
        elif edits:
            out[1] += 1
        elif lexicon.terms[term][-1] == STEM:
            out[2] += 1
        else:
            out[0] += 1
        weight += 0 if quoted else 1 + (not ADDRESS.isdisjoint(near))
    out[4] = weight
    out[5] = 100 * weight / len(tokens)
    out[6] = out[0] + out[1] + out[2] > 0
    return np.log1p(out)


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    coef: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    bias: float = -2.0


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method; classes weigh alike."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), (-2.0 if not len(y) or y[0] == 0 else 2.0)
    z = np.hstack([x, np.ones((len(x), 1))])
    weights = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    keep = np.diag([ridge] * x.shape[1] + [1e-6]) * len(y) / 100
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weights * (p - y)) + keep @ w
        hess = (z * (weights * p * (1 - p) + 1e-9)[:, None]).T @ z + keep
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def choose_terms(seen: pd.DataFrame, n_toxic: int, n_clean: int, min_docs: int = 4, purity: float = 25.0) -> list[str]:
    """Greedy cover of the toxic documents by pure terms.

    seen: term, clean (documents that aren't toxic), toxic_ids (list of toxic documents). The term that covers most
    documents not covered yet comes first, shorter ones first among equals, until none covers min_docs more.
    """
    pure = [
        (t, set(ids)) for t, c, ids in zip(seen["term"], seen["clean"], seen["toxic_ids"])
        if len(ids) >= min_docs and (len(ids) / max(1, n_toxic)) / ((c + 0.5) / max(1, n_clean)) >= purity
    ]
    left, chosen = set().union(*(ids for _, ids in pure)) if pure else set(), []
    # A document may hold several terms, so a term also counts if it is frequent by itself, not only for what is left.
    while pure:
        gain, _, term, ids = max((len(ids & left), -len(t), t, ids) for t, ids in pure)
        if gain < min_docs:
            break
        chosen.append(term)
        left -= ids
        pure = [(t, i) for t, i in pure if i & left]
    return chosen


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = 16000, seed_words: tuple[str, ...] = SEED_WORDS,
) -> ToxicityModel:
    """Lexicon and weights from at most about `sample` labelled documents, chosen by a hash of their ids.

    Rows without label, id or text don't count; of documents with equal texts one counts. Without labelled rows the model
    has the seed words alone and says 1 for none.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    n = known.count()
    share = min(1.0, sample / max(1, n))
    known = known.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) < int(share * 1_000_000))
    # The sample's ids, bounded by `sample`, go to the tasks, so no other text is shuffled.
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
        .join(F.broadcast(known), "id").groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("id", "y", "text")).alias("r")).select("r.*")
    )
    rows = cut(rows)
    sizes = {int(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sum(v for k, v in sizes.items() if k), sizes.get(0, 0)
    word = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    words = F.array_distinct(word)
    terms = F.array_distinct(
        F.flatten(
            F.transform(
                words,
                lambda w: F.concat(
                    F.array(F.concat(w, F.lit(END))),
                    F.transform(F.filter(F.sequence(F.lit(4), F.lit(7)), lambda k: k <= F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k), F.lit(STEM))),
                ),
            )
        )
    )
    min_docs = min(4, 2 + n_toxic // 1000)  # a rare term is chance where many documents are learned from, and all there is where few are
    counted = (
        rows.select("id", "y", F.explode(terms).alias("term"))
        .groupBy("term")
        .agg(F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("clean"), F.sum(F.when(F.col("y") != 0, 1).otherwise(0)).alias("n_tox"))
        .where((F.col("n_tox") >= min_docs) & (F.col("n_tox") * F.lit(max(1, n_clean)) >= 25.0 * max(1, n_toxic) * (F.col("clean") + 0.5)))
    )  # terms of at least min_docs of the sampled documents, so their number is bounded by the sample
    chosen_df = cut(counted)
    tox = rows.where("y <> 0").select("id", F.explode(terms).alias("term"))
    seen = tox.join(chosen_df, "term").groupBy("term", "clean").agg(F.collect_list("id").alias("toxic_ids")).toPandas()
    learned = choose_terms(seen, n_toxic, n_clean, min_docs)
    lexicon_terms = list(dict.fromkeys([w + END for w in seed_words] + learned))
    fitted = rows.select("y", _feature_udf(lexicon_terms)(F.col("text")).alias("x")).toPandas()
    x = np.array(fitted["x"].tolist(), float).reshape(-1, N_FEATURES)
    coef, bias = fit_logistic(x, (fitted["y"].to_numpy() != 0).astype(float))
    return ToxicityModel(lexicon_terms, coef, bias)


def _feature_udf(terms: list[str]):
    @pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(terms)
        for texts in batches:
            yield pd.Series([features(t, lexicon).tolist() for t in texts])

    return of


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col (0 to 1; higher: label 1 likelier) for each row's whole text; replaces a column of that name.

    Null and empty texts have no hits and get the model's lowest score. A map over rows: no shuffle, repeats allowed.
    """
    terms, coef, bias = model.terms, model.coef, model.bias

    @pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(terms)
        for texts in batches:
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(t, lexicon) @ coef) + bias)))) for t in texts], dtype="float64")

    return docs.withColumn(score_col, of(F.col(text_col)))


def training_rows(labels: DataFrame, id_col: str = "doc_id", folds: int = 5, held: int = 0) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where(bucket_of(F.col(id_col), folds) != held)
