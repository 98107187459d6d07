"""Movers on a stream: the tracker of each sensor is kept as state between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import MoverRules, MoverTracker, box_detections
from ..runtime import ship

SCHEMA = "sensor_id long, frame_ts int, track_id long, det_id long, cx double, cy double, vx double, vy double, dx double, dy double, speed double"


def track(detections: DataFrame, rules: MoverRules | None = None) -> DataFrame:
    """Confirmed movers from a stream of boxes (sensor_id, frame_ts, det_id, cx, cy, dx, dy).

    All boxes of a frame arrive in one micro-batch, and frames in order; frames that come late are left out.  The
    state is the tracks alive: boxes of ten frames each.
    """
    ship(detections.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, tracker = pickle.loads(state.get[0]) if state.exists else (None, MoverTracker(rules))
        rows = []
        for frame, own in pd.concat(list(batches)).sort_values(["frame_ts", "det_id"]).groupby("frame_ts", sort=True):
            if last is not None and frame <= last:
                continue
            if last is not None:
                tracker.skip(int(frame - last - 1))
            last = int(frame)
            rows += [{"sensor_id": key[0], "frame_ts": last, **m} for m in tracker.update(box_detections(own))]
        state.update((pickle.dumps((last, tracker)),))
        yield pd.DataFrame(rows, columns=names)

    return detections.groupBy("sensor_id").applyInPandasWithState(step, SCHEMA, "tracker binary", "append", GroupStateTimeout.NoTimeout)
