"""Groups of bounded size worked on whole within tasks; larger ones are told apart for a distributed way."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logosmill.session import broadcast_if_small, cut

LOCAL_ROWS = 100_000  # rows of a group that one task works on


def by_size(rows: DataFrame, keys: list[str], local_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most ``local_rows`` rows, and those of larger ones; None if there are none."""
    large = cut(rows.groupBy(*keys).count().where(F.col("count") > local_rows).select(*keys))
    if large.isEmpty():
        return rows, None
    large = broadcast_if_small(large)
    return rows.join(large, keys, "left_anti"), cut(rows.join(large, keys, "left_semi"))


def on_whole_groups(rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str, frame_rows: int = LOCAL_ROWS) -> DataFrame:
    """Run ``work`` on frames of whole groups, sorted by key; a frame has at most about ``frame_rows`` rows more than one group."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= frame_rows:
                frame = pd.concat(waiting, ignore_index=True)
                last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
                if not last.all():
                    yield from work(frame[~last].reset_index(drop=True))
                    frame = frame[last].reset_index(drop=True)
                waiting, n = [frame], len(frame)
        if n:
            yield from work(pd.concat(waiting, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def places(part: pd.DataFrame, keys: list[str], own: list[str]) -> tuple[list, int]:
    """The columns ``own`` as numbers, equal where group and value are; -1 for null; and how many there are."""
    group = (part[keys] != part[keys].shift()).any(axis=1).cumsum().to_numpy()
    codes, _ = pd.factorize(pd.concat([part[c] for c in own], ignore_index=True).to_numpy(dtype=object))
    width = int(codes.max(initial=0)) + 2
    each = [codes[i * len(part) : (i + 1) * len(part)] for i in range(len(own))]
    joint = pd.concat([pd.Series(group * width + c).where(c >= 0, -1) for c in each], ignore_index=True)
    numbers, found = pd.factorize(joint.where(joint >= 0))
    return [numbers[i * len(part) : (i + 1) * len(part)] for i in range(len(own))], len(found)
