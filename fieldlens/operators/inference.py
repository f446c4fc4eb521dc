"""Detection by a user's model: batches of images in, boxes with labels and scores out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")
_FOUND = pa.list_(pa.struct([*((c, pa.float64()) for c in CORNERS), ("label", pa.int64()), ("score", pa.float64())]))

#: A model takes a list of images and gives, for each, its boxes (n x 4 corners), labels and scores.
Model = Callable[[list], list[dict[str, Any]]]

_loaded: dict[str, Model] = {}


def _model(name: str, make: Callable[[], Model]) -> Model:
    """The worker's model; the one of an earlier query is let go, for models are large."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = make()
    return _loaded[name]


def _rows(found: dict[str, Any]) -> list[dict]:
    boxes, labels, scores = (np.asarray(found[k]) for k in ("boxes", "labels", "scores"))
    boxes = boxes.reshape(-1, 4)
    if not len(boxes) == len(labels) == len(scores):
        raise ValueError(f"{len(boxes)} boxes, {len(labels)} labels and {len(scores)} scores")
    rows = zip(boxes.astype(float).tolist(), labels.tolist(), scores.astype(float).tolist(), strict=True)
    return [dict(zip(CORNERS, box, strict=True)) | {"label": int(label), "score": score} for box, label, score in rows]


def _many(model: Model, images: list) -> list[list[dict]]:
    found = model(images)
    if len(found) != len(images):
        raise ValueError(f"{len(found)} results for {len(images)} images")
    return [_rows(f) for f in found]


def _each(model: Model, images: list) -> Iterator[tuple[list[dict] | None, str | None]]:
    """(boxes, error) of each image. If a batch fails, its images go one by one, so that one bad image costs no other."""
    try:
        yield from [(rows, None) for rows in _many(model, images)]
    except Exception as whole:  # a model is the user's, and may raise anything
        if len(images) == 1:
            yield None, f"{type(whole).__name__}: {whole}"
        else:
            for image in images:
                yield from _each(model, [image])


def predict(
    images: DataFrame, make_model: Callable[[], Model], *, image: str = "content", decode: Callable[[Any], Any] | None = None, batch: int = 8,
    keys: tuple[str, ...] = ("image_id",),
) -> DataFrame:
    """(keys, found array<struct<x1, y1, x2, y2, label, score>>, error): one row for each image.

    make_model() runs once a worker, so weights are loaded there and not sent. The model is called with up to batch decoded
    images of one partition at a time; no more are held. An image without boxes has an empty array. An image that is null,
    that decode() or the model can't take, or whose boxes, labels and scores differ in number, has no array but an error.
    batch changes no result, if the model sees each image for itself.
    """
    name, kept = uuid.uuid4().hex, images.select(*keys, F.col(image).alias("__image"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__image")
    boxes = "array<struct<x1: double, y1: double, x2: double, y2: double, label: bigint, score: double>>"

    def results(values: pa.ChunkedArray | pa.Array, model: Model) -> tuple[list, list]:
        found: list = [None] * len(values)
        errors: list = [None] * len(values)
        held: list[tuple[int, Any]] = []

        def empty() -> None:
            for (i, _), (rows, error) in zip(held, _each(model, [x for _, x in held]), strict=True):
                found[i], errors[i] = rows, error
            held.clear()

        for i, value in enumerate(values):
            raw = value.as_py()
            if raw is None:
                errors[i] = "no image"
                continue
            try:
                held.append((i, decode(raw) if decode else raw))
            except Exception as e:  # an image may be damaged in any way
                errors[i] = f"{type(e).__name__}: {e}"
            if len(held) == batch:
                empty()
        if held:
            empty()
        return found, errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, errors = results(b.column(len(keys)), _model(name, make_model))
            columns = [*(b.column(k) for k in range(len(keys))), pa.array(found, _FOUND), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "found", "error"])

    return kept.mapInArrow(run, f"{kinds}, found {boxes}, error string")


def detections(predicted: DataFrame, *, least_score: float | Column = 0.0, first: str = "place") -> DataFrame:
    """A row for each box of at least least_score, with its place among its image's boxes; images without one have no row.

    Scores that aren't numbers count as below any other. The keys are those of predicted.
    """
    keys = [c for c in predicted.columns if c not in ("found", "error")]
    rows = predicted.select(*keys, F.posexplode("found").alias(first, "__box")).select(*keys, F.col(first).cast("long").alias(first), "__box.*")
    return rows.filter(~F.isnan("score") & (F.col("score") >= least_score))


def failed(predicted: DataFrame) -> DataFrame:
    """The keys of images that gave no result, and why."""
    return predicted.filter("error IS NOT NULL").drop("found")
