"""Streaming forms of operators.  An extension: the batch operators are the reference semantics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logosmill.functions.lexicons import CUES
from logosmill.operators.substrate import cue_scan


def cue_counts(documents: DataFrame, at: str = "published_at", delay: str = "7 days", window: str = "1 day", cues=CUES) -> DataFrame:
    """Cues per time window and label; documents later than ``delay`` are dropped by the watermark."""
    found = cue_scan(documents.withWatermark(at, delay), cues=cues, keep=(at,))
    return found.groupBy(F.window(at, window).alias("w"), "label").agg(F.count("*").alias("n")).select("w.start", "w.end", "label", "n")


def commitments(acts: DataFrame) -> DataFrame:
    """(speaker, act_id, active): number of commitments held after each act, acts in order of ``ord`` within a batch.

    State is one set of keys a speaker.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict.fromkeys(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("ord")
        out = []
        for act, op, k in zip(rows.act_id, rows.op, rows.key):
            if op in ("assert", "concede"):
                held.setdefault(k)
            elif op == "retract":
                held.pop(k, None)
            out.append((key[0], act, len(held)))
        state.update((list(held),))
        yield pd.DataFrame(out, columns=["speaker", "act_id", "active"])

    return acts.groupBy("speaker").applyInPandasWithState(step, "speaker string, act_id bigint, active int", "held array<string>", "append", GroupStateTimeout.NoTimeout)
