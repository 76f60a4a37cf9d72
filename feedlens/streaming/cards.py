"""Which articles a session shows as large cards: decided once for each, and kept however scores, images and the list change."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, inf

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values of the card rule: the share of scores that may be large, and the small cards between two large ones.
TOP_SHARE, MIN_GAP = 0.1, 4
SHOWN = "session string, render long, place long, id long, featured boolean"


def decide(rows: pd.DataFrame, decided: dict[int, bool]) -> list[bool]:
    """Whether each row (id, score, has_image, small) of a list, in order, is large; decided, from lists before, is kept and added to.

    An article that is new is large if at least MIN_GAP others lie behind the last large one, its score is among the best TOP_SHARE of the list's,
    and it has an image that isn't known to be small. A large one whose image turns out small is small from then on.
    """
    rows = rows.assign(score=rows["score"].astype("float64"))
    scores = sorted(rows["score"].dropna(), reverse=True)
    threshold = scores[max(1, ceil(len(scores) * TOP_SHARE)) - 1] if scores else inf
    out, since = [], MIN_GAP
    for key, score, image, small in zip(rows["id"].tolist(), rows["score"], rows["has_image"], rows["small"]):
        large = decided.get(key)
        if large is None:
            large = bool(since >= MIN_GAP and score >= threshold and image)
        decided[key] = large = large and not small
        since = 0 if large else since + 1
        out.append(large)
    return out


def shown_cards(renders: DataFrame, kept_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """SHOWN for each row of a stream of lists as they are rendered: session, render (a number that grows), place, id, score, has_image, small.

    A list is all that a session has loaded, so its scores are those that the threshold is taken from. A list must be in one micro-batch.
    A session's decisions are forgotten when it has rendered nothing for kept_ms.
    """

    def session(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, large = state.get if state.exists else ([], [])
        known = dict.fromkeys(ids, False) | dict.fromkeys(large, True)
        lists = pd.concat(list(parts)).sort_values(["render", "place", "id"])
        for render, shown in lists.groupby("render"):
            yield pd.DataFrame({"session": key[0], "render": render, "place": shown["place"], "id": shown["id"], "featured": decide(shown, known)})
        state.update((list(known), [k for k, v in known.items() if v]))
        state.setTimeoutDuration(kept_ms)

    state = "decided array<long>, featured array<long>"
    return renders.groupBy("session").applyInPandasWithState(session, SHOWN, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def show(renders: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends shown_cards to files, and ends when all that has landed is in. Batches without rows, which would go on for as long as state may expire, are off for this query."""
    conf = renders.sparkSession.conf
    before = conf.get(NO_DATA)
    conf.set(NO_DATA, "false")
    try:
        out = shown_cards(renders).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        return out.outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(NO_DATA, before)
