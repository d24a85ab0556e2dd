"""Voxel points as Spark's own keyed state: a list of points by voxel in the state store, and timers that let go what nobody touches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.voxels import with_voxel
from ..schema import XYZ, require_columns

#: Set this before the stream starts: only this store keeps lists and timers.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "vkey long, point_id long, x double, y double, z double, event string"
KEPT = "point_id long, x double, y double, z double"


class VoxelState(StatefulProcessor):
    """A point is kept unless its voxel is full or a kept one lies too near. A voxel is let go when the watermark is `horizon_ms` past the last point that came to it."""

    def __init__(self, least_distance: float, most_points: int, horizon_ms: int | None) -> None:
        self.d2, self.most, self.horizon = least_distance**2, most_points, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", KEPT)
        self.touched = handle.getValueState("touched", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """The rows of a voxel come in frames; of what has passed, only the kept points are remembered."""
        kept = [np.array(r[1:4], float) for r in self.kept.get()] if self.kept.exists() else []
        last = self.touched.get()[0] if self.touched.exists() else None
        seen = last
        for pdf in rows:
            pdf = pdf.sort_values("point_id")
            top = int(pdf["stamp"].max().timestamp() * 1000)
            seen = top if seen is None else max(seen, top)
            new = self._thin(kept, pdf)
            if len(new):
                self.kept.appendList([(int(r.point_id), float(r.x), float(r.y), float(r.z)) for r in new.itertuples()])
                yield new.assign(vkey=key[0], event="kept")[["vkey", "point_id", *XYZ, "event"]]
        if self.horizon is not None and seen is not None and seen != last:
            if last is not None:
                self.handle.deleteTimer(last + self.horizon)
            self.handle.registerTimer(seen + self.horizon)
            self.touched.update((seen,))

    def _thin(self, kept: list[np.ndarray], pdf: pd.DataFrame) -> pd.DataFrame:
        xyz, chosen = pdf[list(XYZ)].to_numpy(), []
        alive = np.ones(len(xyz), bool)
        for p in kept:
            alive &= ((xyz - p) ** 2).sum(1) >= self.d2
        while len(kept) < self.most and (left := np.flatnonzero(alive)).size:
            at = left[0]
            kept.append(xyz[at])
            chosen.append(at)
            alive[: at + 1] = False
            alive &= ((xyz - xyz[at]) ** 2).sum(1) >= self.d2
        return pdf.iloc[chosen]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        self.touched.clear()
        yield pd.DataFrame({"vkey": [key[0]], "point_id": [None], "x": [None], "y": [None], "z": [None], "event": ["gone"]}).astype({"point_id": "Int64", "x": float, "y": float, "z": float})


def voxel_state_stream(stream: DataFrame, resolution: float, stamp: str = "stamp", least_distance: float = 0.1, most_points: int = 20, horizon_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """A stream of changes (vkey, point_id, x, y, z, event): event 'kept' for a point that a voxel takes, 'gone' for a voxel that is let go.

    The stream needs point_id, x, y, z and a timestamp. Spark keeps each voxel's points in its state store, with the query's checkpoint: a retried batch
    starts from the state before it, a restarted query from where it was. A voxel's points of one micro-batch are taken by point_id within a frame of
    an Arrow batch's size, and frames as they come. Points that are not finite, or too far out for a voxel key, are dropped.
    """
    require_columns(stream, "point_id", *XYZ, stamp)
    keyed = with_voxel(stream, resolution).selectExpr("vkey", "point_id", *XYZ, f"`{stamp}` AS stamp").withWatermark("stamp", delay)
    processor = VoxelState(least_distance, most_points, horizon_ms)
    return keyed.groupBy("vkey").transformWithStateInPandas(processor, OUT, "Append", "EventTime" if horizon_ms is not None else "None")


def stored_points(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(vkey, point_id, x, y, z): what a query's state store holds after its last batch."""
    state = spark.read.format("statestore").option("stateVarName", "kept").load(checkpoint)
    return state.selectExpr("key.vkey AS vkey", "list_element.*")
