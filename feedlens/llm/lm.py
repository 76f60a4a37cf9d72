"""Log-bilinear language model trained with noise-contrastive estimation, and scoring of whole texts.

A token is predicted from the two before it: its context vector is a weighted sum of their vectors, its score the
product with its own vector plus a bias. The most frequent words are classes of their own; all others fall into
classes by their last two bytes and share a class's probability by their counts in the corpus, half a count added.
Counts cover all training texts. Training starts on a bounded sample on the driver; then every task trains on all its
texts from there, and the tasks' parameters are averaged, weighted by tokens. For scoring the classes' probabilities
are normalised exactly: the scores of all context pairs are products of two matrices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import LOWER, UPPER, byte_words, cut

END = 0


@dataclass
class Shape:
    words: int = 1000  # words with a class of their own
    suffixes: int = 32  # classes of all other words
    dim: int = 24
    noise: int = 32
    head: int = 200_000  # words whose counts each task knows; the counts of rarer ones are joined
    batch: int = 4096
    rate: float = 0.08
    sample_tokens: int = 400_000


@dataclass
class Model:
    vectors: np.ndarray  # of context classes; the last row is for places before the text
    targets: np.ndarray
    first: np.ndarray  # weight of the token before, by dimension
    second: np.ndarray
    bias: np.ndarray


PARAMETERS = ("vectors", "targets", "first", "second", "bias")


def suffix_class(word: bytes, n: int) -> int:
    return zlib.crc32(word[-2:]) % n


class Coder:
    """Words to classes: 0 the end, then frequent words, then suffix classes; the number of all is the place before a text."""

    def __init__(self, frequent: list[bytes], suffixes: int):
        self.ids = {w: n + 1 for n, w in enumerate(frequent)}
        self.base, self.suffixes = len(frequent) + 1, suffixes
        self.n = self.base + suffixes

    def classes(self, words: list[bytes]) -> np.ndarray:
        get, base, n, crc = self.ids.get, self.base, self.suffixes, zlib.crc32
        return np.array([get(w) or base + crc(w[-2:]) % n for w in words] + [END], np.int32)

    def contexts(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.full(2, self.n, np.int32)
        padded = np.concatenate([start, classes])
        return padded[1:-1], padded[:-2]


def start(classes: int, share: np.ndarray, dim: int) -> Model:
    rng = np.random.default_rng(7)
    around = lambda rows: rng.normal(0, 0.1, (rows, dim))
    return Model(around(classes + 1), around(classes), np.ones(dim), np.ones(dim), np.log(share))


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """rows added up by the class at[i] of each."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.diff(sorted_at, prepend=-1))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[sorted_at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with Adagrad; the noise words of a batch are drawn once for all its places."""

    def __init__(self, model: Model, share: np.ndarray, shape: Shape, seed: int):
        self.p = {k: getattr(model, k).astype(np.float32) for k in PARAMETERS}
        self.sums = {k: np.full_like(v, 1.0) for k, v in self.p.items()}
        self.rng, self.shape = np.random.default_rng(seed), shape
        self.cumulative = np.cumsum(share)
        self.log_noise = np.log(shape.noise * share).astype(np.float32)
        self.seen = 0

    def step(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, n_classes = self.p, len(self.p["bias"])
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.shape.noise)), n_classes - 1)
        v1, v2 = p["vectors"][one], p["vectors"][two]
        context = v1 * p["first"] + v2 * p["second"]
        target, other = p["targets"][word], p["targets"][noise]
        true = (context * target).sum(1) + p["bias"][word] - self.log_noise[word]
        false = context @ other.T + (p["bias"][noise] - self.log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        toward = up[:, None] * target + down @ other
        both = np.concatenate([word, noise])
        grad = {
            "targets": _summed(np.concatenate([up[:, None] * context, down.T @ context]), both, n_classes),
            "bias": np.bincount(both, np.concatenate([up, down.sum(0)]), n_classes),
            "vectors": _summed(np.concatenate([toward * p["first"], toward * p["second"]]), np.concatenate([one, two]), n_classes + 1),
            "first": (toward * v1).sum(0) / len(word) * 10,
            "second": (toward * v2).sum(0) / len(word) * 10,
        }
        for k, g in grad.items():
            g = g.astype(np.float32)
            self.sums[k] += g * g
            p[k] += self.shape.rate * g / np.sqrt(self.sums[k])
        self.seen += len(word)

    def model(self) -> Model:
        return Model(**self.p)


class Feed:
    """Gathers texts' places into batches for a trainer."""

    def __init__(self, trainer: Trainer, coder: Coder):
        self.trainer, self.coder, self.held, self.n = trainer, coder, [], 0

    def add(self, classes: np.ndarray) -> None:
        self.held.append((classes, *self.coder.contexts(classes)))
        self.n += len(classes)
        if self.n >= 32 * self.trainer.shape.batch:
            self.flush()

    def flush(self) -> None:
        if not self.n:
            return
        columns = [np.concatenate(x) for x in zip(*self.held)]
        order = self.trainer.rng.permutation(self.n)
        for at in range(0, self.n, self.trainer.shape.batch):
            self.trainer.step(*(c[order[at : at + self.trainer.shape.batch]] for c in columns))
        self.held, self.n = [], 0


def log10_tables(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(by the token before, by the one before that, normaliser of the pair): log10 P = a[c1, w] + b[c2, w] - z[c1, c2]."""
    a = (model.vectors * model.first) @ model.targets.T + model.bias
    b = (model.vectors * model.second) @ model.targets.T
    a, b = a.astype(np.float32), b.astype(np.float32)
    a -= a.max(axis=1, keepdims=True)
    b -= b.max(axis=1, keepdims=True)
    # log of the sum over w of exp(a) exp(b): one matrix product for all pairs
    z = np.log(np.maximum(np.exp(a) @ np.exp(b).T, 1e-37))
    ten = np.float32(1 / np.log(10))
    return a * ten, b * ten, z * ten


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, c) over all rows, without the end token."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    return docs.select(F.explode(F.split(text, r"[\x20\x09-\x0D]+")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("c"))


def head_count(counts: DataFrame, most: int) -> float:
    """A count that at most `most` words reach, from a histogram over steps of the logarithm (a few thousand rows)."""
    step = F.floor(F.log(F.col("c").cast("double")) * 64)
    seen, edge = 0, float("inf")
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect():
        seen += row["n"]
        if seen > most:
            break
        edge = float(row["least"])
    return edge


def score_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, learning from the texts of training.

    A text's tokens are its words, A-Z in lower case, and one end; null texts count as empty, so they still have an
    end. base_score: log10 of smoothed unigram probabilities; score: log10 of the model's. Repeated rows are scored,
    and learned from, each for itself; null ids are kept. An empty training table leaves N and V zero: the base and the model
    then give each token its probability among none seen. Other columns aren't read.
    """
    spark = docs.sparkSession
    counts = cut(word_counts(training, text_col))
    ends = training.count()
    totals = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n_words, n_types = totals["n"] or 0, totals["v"]
    n_all, types = n_words + ends, n_types + (ends > 0)
    head = counts.where(F.col("c") >= head_count(counts, shape.head)).toPandas().sort_values(["c", "token"], ascending=[False, True])
    head_words = [w.encode("utf-8", "surrogatepass") for w in head["token"]]
    head_counts = head["c"].to_numpy(np.int64)
    coder = Coder(head_words[: shape.words], shape.suffixes)
    frequent = len(head_words[: shape.words])

    # Totals of the suffix classes: half a count more for each word, and a half for the word never seen.
    suffix = F.pmod(F.crc32(F.substring(F.col("token").cast("binary"), -2, 2)), F.lit(shape.suffixes)).cast("int")
    sums = {r["s"]: (r["n"], r["v"]) for r in counts.groupBy(suffix.alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    mass = np.array([sums.get(s, (0, 0)) for s in range(shape.suffixes)], float).reshape(-1, 2)
    for word, c in zip(head_words[:frequent], head_counts[:frequent]):
        mass[suffix_class(word, shape.suffixes)] -= (c, 1)
    class_total = np.concatenate([[ends + 0.5], head_counts[:frequent] + 0.5, mass[:, 0] + 0.5 * mass[:, 1] + 0.5])
    share = class_total / class_total.sum()

    model = train(training.select(F.col(text_col).alias("text")), coder, share, shape, n_all)
    a, b, z = log10_tables(model)
    log_class = np.log10(mass[:, 0] + 0.5 * mass[:, 1] + 0.5)
    denominator = float(np.log10(n_all + 0.5 * (types + 1)))
    shared = spark.sparkContext.broadcast((head_words, np.log10(head_counts + 0.5), coder, a, b, z, log_class))  # bounded by shape
    end_base = float(np.log10(ends + 0.5))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_known, log_counts, coder, a, b, z, log_class = shared.value
        place = {w: n for n, w in enumerate(words_known)}
        for batch in batches:
            rows: list[tuple] = []
            tails: list[tuple[int, list[bytes]]] = []
            for key, row, text in zip(batch["k"], batch["row_id"], batch["text"]):
                words = byte_words(text)
                at = [place.get(w, -1) for w in words]
                tail = [w for w, n in zip(words, at) if n < 0]
                at = np.array(at, np.int64)
                known = log_counts[at[at >= 0]]
                classes = coder.classes(words)
                one, two = coder.contexts(classes)
                score = float((a[one, classes] + b[two, classes] - z[one, two]).sum(dtype=np.float64))
                rare = classes >= coder.base
                score -= float(log_class[classes[rare] - coder.base].sum())
                score += float(log_counts[at[(at >= coder.base - 1)]].sum())
                base = float(known.sum()) + end_base - denominator * len(classes)
                # a blank keeps this row from meeting any word; the key spreads such rows
                rows.append((key, row, f" {key}", 1, len(classes), len(known) + (ends > 0), base, score))
                if tail:
                    tails.append((key, tail))
            yield pd.DataFrame(rows, columns=COLUMNS)
            if tails:
                token = [w.decode("utf-8", "surrogatepass") for _, tail in tails for w in tail]
                keys = np.repeat([k for k, _ in tails], [len(t) for _, t in tails])
                yield pd.DataFrame({"k": keys, "row_id": None, "token": token, "own": 0, "n_tokens": 0, "n_known": 0, "base": 0.0, "score": 0.0})

    kind = docs.schema[id_col].dataType
    row_id = F.col(id_col).cast("string")
    # A row is known by its id and text, whatever task it is in; repeated rows are told from one another by their number alone.
    keyed = docs.select(F.xxhash64(row_id, F.col(text_col)).alias("k"), row_id.alias("row_id"), F.col(text_col).alias("text"))
    rows = keyed.mapInPandas(
        scan, "k long, row_id string, token string, own int, n_tokens long, n_known long, base double, score double"
    )
    # Words outside the head: their counts are joined; no word among them has more than 1 / head of all places.
    joined = rows.join(counts, "token", "left")
    log_count = F.when(F.col("own") == 0, F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)).otherwise(0.0)
    known = F.col("n_known") + F.when((F.col("own") == 0) & (F.col("c") > 0), 1).otherwise(0)
    summed = joined.groupBy("k").agg(
        F.sum("own").alias("m"), F.max("row_id").alias("row_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"),
        F.sum(F.col("base") + log_count).alias("base"), F.sum(F.col("score") + log_count).alias("score"),
    )
    whole = lambda c: (F.col(c) / F.col("m")).cast("long").alias(c)
    found = summed.select("row_id", whole("n_tokens"), whole("n_known"), (F.col("base") / F.col("m")).alias("base_score"), (F.col("score") / F.col("m")).alias("score"), F.explode(F.expr("array_repeat(0, cast(m as int))")))
    return found.select(F.col("row_id").cast(kind).alias(id_col), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


COLUMNS = ["k", "row_id", "token", "own", "n_tokens", "n_known", "base", "score"]


def train(texts: DataFrame, coder: Coder, share: np.ndarray, shape: Shape, n_all: int) -> Model:
    """A warm start on shape.sample_tokens tokens (and the rest of the last text), then one pass over all texts in parallel, averaged."""
    spark = texts.sparkSession
    model = start(coder.n, share, shape.dim)
    if not n_all:
        return model
    part = min(1.0, shape.sample_tokens / n_all)
    some = texts.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < int(2 * part * 1_000_000) + 1)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"c": [coder.classes(byte_words(t)).tobytes() for t in batch["text"]]})

    warm = Trainer(model, share, shape, seed=1)
    feed = Feed(warm, coder)
    sample, held = [], 0
    # texts of the sample, each once, in the order of their hashes until they have sample_tokens tokens
    once = some.mapInPandas(coded, "c binary").groupBy(F.xxhash64("c").alias("h")).agg(F.first("c").alias("c"))
    for row in once.orderBy("h").toLocalIterator():
        sample.append(np.frombuffer(row["c"], np.int32))
        held += len(sample[-1])
        if held >= shape.sample_tokens:
            break
    for _ in range(3):
        for classes in sample:
            feed.add(classes)
        feed.flush()
    begin = spark.sparkContext.broadcast((warm.model(), warm.sums))
    finer = replace(shape, rate=shape.rate / 2)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, sums = begin.value
        trainer = Trainer(first, share, finer, seed=2 + TaskContext.get().partitionId())
        trainer.sums = {k: v.copy() for k, v in sums.items()}
        own = Feed(trainer, coder)
        for batch in batches:
            for text in batch["text"]:
                own.add(coder.classes(byte_words(text)))
        own.flush()
        if trainer.seen:
            for name in PARAMETERS:
                rows = trainer.p[name].astype(float)
                rows = rows[:, None] if name == "bias" else np.atleast_2d(rows)
                yield pd.DataFrame({"name": name, "at": np.arange(len(rows)), "v": list(rows * trainer.seen), "n": float(trainer.seen)})

    learned = texts.mapInPandas(learn, "name string, at int, v array<double>, n double")
    mean = lambda d: F.array(*[F.sum(F.element_at("v", i + 1)) / F.sum("n") for i in range(d)]).alias("v")
    out = {}
    learned = cut(learned)
    wide = learned.where("name in ('vectors', 'targets', 'first', 'second')").groupBy("name", "at").agg(mean(shape.dim)).toPandas()
    for name in ("vectors", "targets", "first", "second"):
        out[name] = np.array(wide[wide["name"] == name].sort_values("at")["v"].tolist())
    biases = learned.where("name = 'bias'").groupBy("at").agg(mean(1)).toPandas().sort_values("at")
    out["bias"] = np.array(biases["v"].tolist())[:, 0]
    for name in ("first", "second"):
        out[name] = out[name][0]
    return Model(**out)
