"""Message plausibility as a stateful stream, keyed by receiver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "receiver long, id long, sender long, t double, dt double, ego_x double, ego_y double, distance double, n_neighbours long, min_distance double, n_sender_pseudos long, hits string"


class MessageState(StatefulProcessor):
    """Holds the receiver's own state, each pseudonym's latest message and the values of thresholds fitted before.

    A pseudonym's entry expires after ttl_ms, so state doesn't grow with all pseudonyms ever seen. Records of a
    micro-batch are taken by (t, id); messages before the first own state are dropped and enter no history.
    Neighbours are the latest messages of other pseudonyms at most `span` seconds old and `radius` away.
    thresholds: feature (a column of the output) to {"op", "threshold"}; hits lists the features that they mark.
    """

    def __init__(self, ttl_ms: int = 600_000, span: float = 1.0, radius: float = 30.0, thresholds: dict[str, dict] | None = None) -> None:
        self.ttl_ms, self.span, self.radius, self.thresholds = ttl_ms, span, radius, thresholds or {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ego = handle.getValueState("ego", "x double, y double")
        self.last = handle.getMapState("last", "pseudo long", "t double, x double, y double, sender long", self.ttl_ms)

    def _hits(self, row: dict) -> str:
        test = {"le": float.__le__, "lt": float.__lt__, "ge": float.__ge__, "gt": float.__gt__}
        return ",".join(f for f, t in sorted(self.thresholds.items()) if row.get(f) is not None and test[t["op"]](float(row[f]), float(t["threshold"])))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        ego, out = (self.ego.get() if self.ego.exists() else None), []
        known = {k[0]: tuple(v) for k, v in self.last.iterator()}
        fresh: set[int] = set()
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["t", "id"])
        for r in batch.itertuples(index=False):
            if r.type == 2:
                ego = (float(r.x), float(r.y))
                continue
            if ego is None:
                continue
            me, sender = int(r.pseudo), int(r.sender)
            before = known.get(me)
            near = [d for p, (t, x, y, _) in known.items() if p != me and t >= r.t - self.span and (d := math.hypot(r.x - x, r.y - y)) <= self.radius]
            same = {p for p, (t, _, _, s) in known.items() if s == sender and t >= r.t - self.span} | {me}
            row = {
                "receiver": key[0], "id": r.id, "sender": sender, "t": r.t, "dt": r.t - before[0] if before is not None and r.t > before[0] else None, "ego_x": ego[0], "ego_y": ego[1],
                "distance": math.hypot(r.x - ego[0], r.y - ego[1]), "n_neighbours": len(near), "min_distance": min(near, default=None), "n_sender_pseudos": len(same),
            }
            row["hits"] = self._hits(row)
            out.append(row)
            known[me] = (float(r.t), float(r.x), float(r.y), sender)
            fresh.add(me)
        if ego is not None:
            self.ego.update(ego)
        for p in fresh:
            self.last.updateValue((p,), known[p])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stateful_messages(msgs: DataFrame, ttl_ms: int = 600_000, span: float = 1.0, radius: float = 30.0, thresholds: dict[str, dict] | None = None) -> DataFrame:
    """msgs (receiver, id, sender, pseudo, t, type, x, y): each message with ego state, gap to its pseudonym's last one, neighbours and threshold hits.

    thresholds come from a fit on earlier data, as fit_thresholds gives them (t1 or t2 of each feature).
    """
    state = MessageState(ttl_ms, span, radius, thresholds)
    return msgs.groupBy("receiver").transformWithStateInPandas(state, outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")


def sliding_counts(msgs: DataFrame, time: str, window: str = "10 seconds", step: str = "5 seconds", late: str = "30 seconds") -> DataFrame:
    """Messages and senders by receiver and sliding window, late data up to `late`. Windows are epoch-aligned and half-open."""
    from pyspark.sql import functions as F

    w = msgs.withWatermark(time, late).groupBy(F.window(time, window, step), "receiver")
    return w.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("sender").alias("n_senders"))
