"""Feedback signals from a stream of calls, with event time.

A state per user holds the last search; a follow-up within its gate gives a signal. Late rows beyond the watermark are
dropped, and a user's state ends with the event-time timeout. The batch form is quarry.operators.learning.signals.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.learning import BASE_LR, FEATURES, FOLLOWS, MOST, NEGATIVE

_STATE = "ts long, event_id long, k long"
_OUT = "user_id long, event_id long, ts timestamp, signal string, search_id long"


def stream_signals(calls: DataFrame, follow_seconds: int = 30, refine_seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """user_id, event_id, ts, signal, search_id of a streaming frame (user_id, event_id, ts timestamp, tool, k)."""
    kinds = {tool: signal for tool, signal, _ in FOLLOWS}
    gate = max(follow_seconds, refine_seconds) * 1_000_000

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = state.getOption
        out = []
        for r in rows.itertuples():
            at = int(r.ts.value // 1000)
            asked = -1 if r.k is None or pd.isna(r.k) else int(r.k)
            if last is not None:
                gap = at - last[0]
                if r.tool == "search" and asked != last[2] and 0 <= gap < refine_seconds * 1_000_000:
                    out.append((key[0], r.event_id, r.ts, "query_refinement", last[1]))
                elif r.tool in kinds and 0 <= gap < follow_seconds * 1_000_000:
                    out.append((key[0], r.event_id, r.ts, kinds[r.tool], last[1]))
            if r.tool == "search":
                last = (at, int(r.event_id), asked)
        if last is not None:
            state.update(last)
            state.setTimeoutTimestamp(max((last[0] + gate) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "signal", "search_id"])

    rows = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return rows.groupBy("user_id").applyInPandasWithState(step, _OUT, _STATE, "append", "EventTimeTimeout")


def windowed_counts(calls: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """window_start, tool, n: calls in event-time windows."""
    rows = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return rows.groupBy(F.window("ts", window), "tool").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "tool", "n")


def stream_weights(signals: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """pattern, n, feature, weight after each micro-batch that has signals (ts, event_id, signal, pattern) of a pattern.

    The state of a pattern is its count and a weight for each feature; signals of a batch are folded in their order. The
    batch form is quarry.operators.learning.learned.
    """
    names = [*FEATURES, "config_xml_dir"]
    features = {signal: f for _, signal, f in FOLLOWS}

    def step(key, frames, state):
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        n, weights = state.getOption or (0, [0.0] * len(names))
        weights = dict(zip(names, weights, strict=True))
        for signal in rows["signal"]:
            followed = features.get(signal)
            if followed is None:
                continue
            n += 1
            lr = BASE_LR / (1 + n * 0.1)
            for f in FEATURES:
                weights[f] = min(MOST, weights[f] + lr) if f == followed else max(-MOST, weights[f] - lr * NEGATIVE)
            if signal == "refinement_to_config":
                weights["config_xml_dir"] = min(MOST, weights["config_xml_dir"] + lr * 0.5)
        state.update((n, list(weights.values())))
        yield pd.DataFrame({"pattern": key[0], "n": n, "feature": names, "weight": [weights[f] for f in names]})

    rows = signals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return rows.groupBy("pattern").applyInPandasWithState(step, "pattern long, n long, feature string, weight double", "n long, weights array<double>", "update", "NoTimeout")
