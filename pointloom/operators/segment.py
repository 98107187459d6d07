"""Labels for all points of a scan: projection, network, collapse of its classes, and the way back to the points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from . import rangeimage, semantics
from .clusters import by_frames

#: Channels of the network, in its order.
CHANNELS = ("range", "x", "y", "z", "intensity")


def normalised(pixels: DataFrame, mean: dict[str, float], std: dict[str, float]) -> DataFrame:
    """The image's channels less their mean, in deviations; a pixel without return is zero in all, and a label that is no
    class is ignored."""
    there = F.col("range") > 0
    out = {f"f_{c}": F.when(there, (F.col(c) - mean[c]) / max(std[c], 1e-6)).otherwise(0.0) for c in CHANNELS}
    if "label" in pixels.columns:
        out["label"] = F.when(F.col("label").between(0, len(C.FINE) - 1), F.col("label")).otherwise(C.IGNORE).cast("int")
    return pixels.withColumns(out)


def segment(points: DataFrame, network: Callable[[DataFrame], DataFrame], height: int = rangeimage.HEIGHT, width: int = rangeimage.WIDTH, min_conf: float = 0.0, obj_min_conf: float = 0.0) -> DataFrame:
    """(frame_ts, idx, label, obj_class, confidence, fine) for every point (frame_ts, idx, x, y, z, intensity).

    network: adds logits, an array of one number for each class, to pixels.  Classes are collapsed for each pixel, over
    the whole distribution, and only then handed to the points: labels and objects by a vote of near pixels, confidence
    to the point that the pixel shows.  A point that no pixel shows has confidence 0; if its vote says ground, it is
    unknown, and it is no object.
    """
    at = rangeimage.project(points.withColumn("label", F.lit(C.IGNORE)), height, width)
    pixels = semantics.collapse(network(rangeimage.z_buffer(at, "intensity")), min_conf=min_conf, obj_min_conf=obj_min_conf)
    pixels = pixels.select("frame_ts", "v", "u", "idx", "range", "label", "obj_class", "confidence", "fine")
    out = points.select("frame_ts", "idx")
    for value in ("label", "obj_class", "fine"):
        out = out.join(rangeimage.knn_labels(at, pixels, value=value), ["frame_ts", "idx"], "left")
    out = out.join(pixels.select("frame_ts", "idx", F.col("confidence").cast("double").alias("confidence")), ["frame_ts", "idx"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    unseen = F.col("confidence") <= 0
    label, kind = F.coalesce("label", F.lit(C.UNKNOWN)), F.coalesce("obj_class", F.lit(0))
    return out.select("frame_ts", "idx", F.when(unseen & (label == 0), C.UNKNOWN).otherwise(label).alias("label"), F.when(unseen, 0).otherwise(kind).alias("obj_class"), "confidence", F.coalesce("fine", F.lit(C.IGNORE)).alias("fine"))


def session_network(load: Callable[[], Callable[[np.ndarray], np.ndarray]], height: int, width: int, mean: dict[str, float], std: dict[str, float]) -> Callable[[DataFrame], DataFrame]:
    """A network that runs in a session of its own on each worker, such as one of an exported graph: load gives a function
    from a dense image (channels, height, width) to logits (classes, height, width), and is called once for each worker.

    A graph that gives anything else than one logit for each class raises.
    """
    classes, held = len(C.FINE), {}

    def network(pixels: DataFrame) -> DataFrame:
        features = normalised(pixels, mean, std)
        columns = [c for c in pixels.columns if c != "frame_ts"]

        def work(rows: pd.DataFrame, frame: np.ndarray) -> pd.DataFrame:
            if "run" not in held:
                held["run"] = load()
            run = held["run"]
            logits = np.zeros((len(rows), classes))
            cuts = np.flatnonzero(np.diff(frame)) + 1
            for own in np.split(np.arange(len(rows)), cuts):
                image = np.zeros((len(CHANNELS), height, width), np.float32)
                v, u = rows.v.to_numpy()[own], rows.u.to_numpy()[own]
                image[:, v, u] = rows[[f"f_{c}" for c in CHANNELS]].to_numpy(np.float32)[own].T
                got = run(image)
                if got.shape != (classes, height, width):
                    raise ValueError(f"the graph gives {got.shape}, not one logit for each of {classes} classes")
                logits[own] = got[:, v, u].T
            return rows[["frame_ts", *columns]].assign(logits=list(logits))

        schema = pixels.select("frame_ts", *columns).schema.simpleString()[7:-1]
        return by_frames(features, work, ", ".join(x.replace(":", " ", 1) for x in schema.split(",")) + ", logits array<double>", ["v", "u"])

    return network


def onnx_network(graph: bytes, height: int, width: int, mean: dict[str, float], std: dict[str, float]) -> Callable[[DataFrame], DataFrame]:
    """session_network of an ONNX graph with one input (1, channels, height, width) and one output."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(graph, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda image: session.run(None, {name: image[None]})[0][0]

    return session_network(load, height, width, mean, std)
