"""Language identification by string kernels.

A text is the set of character n-grams, of one to three characters, that it holds (a blended spectrum with presence,
not counts), hashed to 2^16 places. The kernel of two texts is the size of the common set over the geometric mean of
their sizes. Landmarks of every language give Nyström features, on which one-versus-rest ridge regression is solved.
The landmarks' weights are multiplied out to weights of n-grams, so that texts are scored in batches by one product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from feedlens.llm.common import cut

PLACES = 1 << 16
LETTER = re.compile(r"[^\W\d_]")
#: Characters below 0x3000 that aren't letters count as a blank.
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(0x3000)], np.uint32)
_MULTIPLY = np.uint32(2654435761)


def places(text: str, longest: int = 3) -> list[np.ndarray]:
    """For each n up to the longest, the hashed places of the text's n-grams, in text order."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < len(_FOLD), _FOLD[np.minimum(codes, len(_FOLD) - 1)], codes)
    out, mixed = [], np.zeros(len(codes), np.uint32)
    for n in range(1, longest + 1):
        if len(codes) < n:
            break
        mixed = mixed[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        spread = (mixed ^ (mixed >> np.uint32(15))) * _MULTIPLY
        out.append(spread >> np.uint32(16))
    return out


def presence(texts: list[str | None]) -> np.ndarray:
    """A float32 row of 0 and 1 for each text, divided by the root of its number of n-grams."""
    out = np.zeros((len(texts), PLACES), np.float32)
    for row, text in zip(out, texts):
        for at in places(text) if text else ():
            row[at] = 1
    return out


def normalised(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(1, rows.sum(axis=1, keepdims=True)))


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # PLACES x langs
    sharpness: float = 6.0


def fit(rows: np.ndarray, labels: list[str], landmarks_per_lang: int = 64, ridge: float = 0.01) -> LanguageModel:
    """rows: packed presence bits, one uint8 row of PLACES / 8 for each training text."""
    langs = sorted(set(labels))
    y = np.array([langs.index(label) for label in labels])
    if not langs:
        return LanguageModel([], np.zeros((PLACES, 0), np.float32))
    chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks_per_lang] for k in range(len(langs))])
    unpacked = lambda part: normalised(np.unpackbits(part, axis=1).astype(np.float32))
    marks = unpacked(rows[chosen])
    kernel = np.concatenate([unpacked(rows[at : at + 64]) @ marks.T for at in range(0, len(rows), 64)]).astype(float)
    values, vectors = np.linalg.eigh(kernel[chosen])
    kept = values > 1e-6 * values.max()
    half = vectors[:, kept] / np.sqrt(values[kept])
    phi = kernel @ half
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    share = np.bincount(y, minlength=len(langs)) / len(y)
    each = 1 / share[y]
    solved = np.linalg.solve((phi * each[:, None]).T @ phi + ridge * len(y) * np.eye(phi.shape[1]), (phi * each[:, None]).T @ target)
    return LanguageModel(langs, (marks.T @ (half @ solved)).astype(np.float32))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = 3000) -> LanguageModel:
    """Fits on at most about `sample` rows, as many of each language, chosen by a hash of id and text.

    Rows without text, letters or language don't count; repeated texts of a language count once. What reaches the
    driver is a packed bit row (8 KB) for each sampled text, however long it is.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, PLACES // 8), np.uint8), [])
    each = max(20, sample // len(counts))
    top = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, 1.5 * each / n) * 1_000_000) + 1))])
    some = known.where(F.pmod("h", F.lit(1_000_000)) < F.element_at(top, F.col("lang")))
    some = some.dropDuplicates(["lang", "h"]).withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= each)

    @pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(presence([t])[0].astype(np.uint8)).tobytes() if LETTER.search(t) else None for t in texts], dtype=object)

    got = some.select("lang", "h", bits("text").alias("bits")).where("bits is not null").toPandas().sort_values(["lang", "h"])
    rows = np.frombuffer(b"".join(map(bytes, got["bits"])), np.uint8).reshape(-1, PLACES // 8)
    return fit(rows, got["lang"].tolist())


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", batch: int = 64) -> DataFrame:
    """docs with lang_pred (und if the text is null or has no letter, or nothing was learned) and score, 0 to 1.

    A map over rows; columns of those names are replaced. Ties go to the language that sorts first.
    """
    langs, weights, sharpness = model.langs, model.weights, model.sharpness

    @pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = [], []
            for at in range(0, len(texts), batch):
                part = [t if t and LETTER.search(t) else None for t in texts[at : at + batch]]
                rows = presence(part)
                raw = (rows @ weights) / np.sqrt(np.maximum(1, rows.sum(axis=1, keepdims=True)))
                for text, row in zip(part, raw):
                    if text is None or not langs:
                        names.append("und"), scores.append(0.0)
                    else:
                        odds = np.exp(sharpness * (row - row.max()).astype(float))
                        names.append(langs[int(row.argmax())]), scores.append(float(odds.max() / odds.sum()))
            yield pd.DataFrame({"lang_pred": names, "score": np.array(scores, float)})

    said = of(F.col(text_col))
    return docs.withColumn("__said", said).withColumns({"lang_pred": F.col("__said.lang_pred"), "score": F.col("__said.score")}).drop("__said")
