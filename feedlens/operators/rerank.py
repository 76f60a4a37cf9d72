"""Orders of a page that depend on what stands above: calibrated re-ranking, exploration slots, spacing, packing.

A page is a bounded group (a reader's page or a category's top rows); pages are independent, so Spark deals them out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 0.01
FLOOR = 0.02


def target(values: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the values, wanted share of each code): softmax of the values' weights with a floor; uniform without weights."""
    names, first, codes = np.unique(values, return_index=True, return_inverse=True)
    if weight is None:
        return codes, np.full(len(names), 1 / len(names))
    logits = weight[first]
    p = np.exp(logits - logits.max())
    p = np.maximum(p / p.sum(), FLOOR)
    return codes, p / p.sum()


def calibrated(score: np.ndarray, dimensions: list[tuple[np.ndarray, np.ndarray]], strength: float = 0.3) -> list[int]:
    """An order of the candidates, each next one the best of (1 - strength) * score - strength * divergence; ties to the first.

    The divergence of a dimension is the smoothed Kullback-Leibler one of its wanted shares from what the page has so far;
    a step needs its sum once and a correction for each label, looked up for all candidates at once.
    """
    n = len(score)
    spread = score.max() - score.min() if n else 0
    norm = (score - score.min()) / spread if spread > 1e-9 else np.ones(n)
    counts = [np.zeros(len(q)) for _, q in dimensions]
    free, out = np.ones(n, bool), []
    for k in range(1, n + 1):
        penalty = np.zeros(n)
        for (codes, q), have in zip(dimensions, counts):
            before = np.log((have + EPS) / (k + EPS * max(1, len(q))))
            penalty += (q * (np.log(q) - before)).sum() + (q * np.log((have + EPS) / (have + 1 + EPS)))[codes]
        best = int(np.argmax(np.where(free, (1 - strength) * norm - strength * penalty, -np.inf)))
        out.append(best)
        free[best] = False
        for (codes, _), have in zip(dimensions, counts):
            have[codes[best]] += 1
    return out


def explore(order: list[int], score: np.ndarray, eligible: np.ndarray, feed: np.ndarray, votes: np.ndarray, every: int = 10) -> list[int]:
    """Every tenth place goes to an unseen article of the page's lower half, unless it already stands higher.

    Articles take turns by score, then fewest votes for their topic, then where they stand; each slot takes one of a feed that
    had none yet while there is such a feed. So the turns are: first the best of each feed, then all others.
    """
    n = len(order)
    if n <= every:
        return order
    lower = np.array([i for i in order[n // 2 :] if eligible[i]], int)
    ranked = lower[np.lexsort((np.arange(len(lower)), votes[lower], -score[lower]))]
    leads = np.zeros(len(ranked), bool)
    leads[np.unique(feed[ranked], return_index=True)[1]] = True
    turns = np.concatenate([ranked[leads], ranked[~leads]])
    out = list(order)
    for slot, chosen in zip(range(every - 1, n, every), turns.tolist()):
        if out.index(chosen) > slot:
            out.remove(chosen)
            out.insert(slot, chosen)
    return out


def rerank_pages(candidates: DataFrame, page: str = "page", strength: float = 0.3, every: int = 0) -> DataFrame:
    """candidates (page, id, source_id, primary_topic, region, article_type, vote, times, topic_votes, score, and the weights of
    their labels t_topic, t_region, t_type) with `place` within the page.

    A label's wanted share follows from the weight that its articles carry; every > 0 adds exploration slots.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        label = lambda c: rows[c].fillna("unknown").to_numpy(str)
        dims = [target(rows["source_id"].to_numpy(), None)]
        dims += [target(label(c), rows[w].to_numpy(float)) for w, c in (("t_topic", "primary_topic"), ("t_region", "region"), ("t_type", "article_type"))]
        score = rows["score"].to_numpy(float)
        order = calibrated(score, dims, strength)
        if every:
            fresh = (rows["vote"].fillna("") != "show_less").to_numpy() & (rows["times"].fillna(0) == 0).to_numpy()
            order = explore(order, score, fresh, rows["source_id"].to_numpy(), rows["topic_votes"].fillna(0).to_numpy(), every)
        return pd.DataFrame({page: rows[page].iloc[order].to_numpy(), "id": rows["id"].iloc[order].to_numpy(), "place": np.arange(1, len(rows) + 1)})

    kind = candidates.schema[page].dataType.simpleString()
    return candidates.groupBy(page).applyInPandas(one, f"`{page}` {kind}, id long, place int")


def spaced(rows: DataFrame, group: str, order: str, wanted: str, gap: int = 4) -> DataFrame:
    """rows with `picked`: wanted rows in order, with at least `gap` unpicked rows in between."""

    def one(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(order, kind="stable")
        picked, since = [], gap
        for want in page[wanted]:
            hit = bool(want) and since >= gap
            picked.append(hit)
            since = 0 if hit else since + 1
        return page.assign(picked=picked)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(group).applyInPandas(one, f"{fields}, picked boolean")


def packed(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """rows with `batch`: consecutive rows of a group while their sizes stay within the budget, a larger row alone.

    A fold over the group's ordered sizes in the JVM; a group is one document's blocks.
    """
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))),
        F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<o:bigint,b:int>>").alias("out")),
        lambda acc, x: F.when(
            (acc["used"] > 0) & (acc["used"] + x["s"] > budget),
            F.struct((acc["batch"] + 1).alias("batch"), x["s"].alias("used"), F.concat(acc["out"], F.array(F.struct(x["o"].cast("bigint").alias("o"), (acc["batch"] + 1).alias("b")))).alias("out")),
        ).otherwise(
            F.struct(acc["batch"].alias("batch"), (acc["used"] + x["s"]).alias("used"), F.concat(acc["out"], F.array(F.struct(x["o"].cast("bigint").alias("o"), acc["batch"].alias("b")))).alias("out"))
        ),
    )
    return rows.groupBy(group).agg(folded["out"].alias("x")).select(group, F.inline("x")).withColumnsRenamed({"o": order, "b": "batch"})
