"""Frames of image sequences as a data source, and frame measures.

``frames`` lists ``<video_id>/<prefix><number>.<png|jpg>`` below a folder, one
partition a video and frame range. With the option ``pushdown`` ranges on
``frame_idx`` that a query filters by go into the listing, so files outside are
not opened.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .. import schemas
from ..functions import kernels as K

MEASURES = "sharpness double, mean double, std double, signature array<float>, histogram array<double>"


class FrameRange(InputPartition):
    def __init__(self, video: str, files: list[tuple[int, str]]):
        self.video, self.files = video, files


class FrameReader(DataSourceReader):
    def __init__(self, root: str, size: int):
        self.root, self.size, self.low, self.high = root, size, None, None

    def partitions(self) -> list[InputPartition]:
        out = []
        for video in sorted(os.listdir(self.root)):
            folder = os.path.join(self.root, video)
            if not os.path.isdir(folder):
                continue
            files = []
            for name in os.listdir(folder):
                m = re.search(r"(\d+)\.(png|jpe?g)$", name, re.IGNORECASE)
                if m and (self.low is None or int(m[1]) >= self.low) and (self.high is None or int(m[1]) <= self.high):
                    files.append((int(m[1]), os.path.join(folder, name)))
            files.sort()
            out += [FrameRange(video, files[k : k + self.size]) for k in range(0, len(files), self.size)]
        return out or [FrameRange("", [])]

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        for number, path in partition.files:
            with open(path, "rb") as f:
                yield partition.video, number, path, f.read()


class FilteredFrameReader(FrameReader):
    """Takes filters on ``frame_idx`` into the listing; Spark must allow it (``spark.sql.python.filterPushdown.enabled``)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_idx",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                v = f.value
                low = v + 1 if isinstance(f, GreaterThan) else v if isinstance(f, GreaterThanOrEqual | EqualTo) else None
                high = v - 1 if isinstance(f, LessThan) else v if isinstance(f, LessThanOrEqual | EqualTo) else None
                if low is not None:
                    self.low = low if self.low is None else max(self.low, low)
                if high is not None:
                    self.high = high if self.high is None else min(self.high, high)
            else:
                yield f


class FrameSource(DataSource):
    """``spark.dataSource.register(FrameSource)``, then ``spark.read.format("frames").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "video_id string, frame_idx long, path string, content binary"

    def reader(self, schema) -> FrameReader:
        kind = FilteredFrameReader if self.options.get("pushdown", "false").lower() == "true" else FrameReader
        return kind(self.options["path"].removeprefix("file://"), int(self.options.get("frames_a_partition", 500)))


def _per_image(images: DataFrame, fields: str, measure) -> DataFrame:
    keep = [c for c in images.columns if c != "data"]
    kinds = dict(images.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [measure(K.decode(bytes(r.data), r.height, r.width, r.nChannels)) for r in batch.itertuples(index=False)]
            yield pd.concat([batch[keep].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    return images.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), fields]))


def measured(images: DataFrame) -> DataFrame:
    """Rows of the image source with sharpness, mean, deviation, signature and colour histogram."""
    return _per_image(images, MEASURES, K.measures)


def color_findings(images: DataFrame) -> DataFrame:
    return _per_image(images, f"color_findings array<{schemas.COLOR_FINDING}>", lambda x: {"color_findings": K.color_anomalies(x)})


def shape_findings(images: DataFrame) -> DataFrame:
    fields = ("shape", "zone", "area", "bbox", "centroid", "confidence", "length", "angle", "endpoints", "radius", "edge_coverage", "grad_mean_diff", "grad_std_diff", "score", "regularity", "right_angles", "rect_score", "side_ratio", "circularity")
    full = lambda f: {k: f.get(k) for k in fields}
    return _per_image(images, f"shapes array<{schemas.SHAPE_FINDING}>", lambda x: {"shapes": [full(f) for f in K.shapes(x)]})


def enhanced(images: DataFrame, variant: str = "v3") -> DataFrame:
    """Rows of the image source with ``png``: the variant as a PNG file."""
    return _per_image(images, "png binary", lambda x: {"png": K.png(K.enhanced(x, variant))})


def wanted(frames: DataFrame, picks: DataFrame) -> DataFrame:
    """Random access as one pass: a semi-join of (video_id, frame_idx)."""
    return frames.join(picks.select("video_id", "frame_idx").distinct(), ["video_id", "frame_idx"], "left_semi")


def write_binary(rows: DataFrame, path_column: str, data_column: str, root: str) -> DataFrame:
    """Write each row's bytes to a file below ``root``; returns the paths. A rerun writes the same file again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, folder = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name, data in zip(batch[path_column], batch[data_column], strict=True):
                fs.create_dir(f"{folder}/{os.path.dirname(name)}".rstrip("/"), recursive=True)
                with fs.open_output_stream(f"{folder}/{name}") as f:
                    f.write(bytes(data))
            yield pd.DataFrame({"path": batch[path_column]})

    return rows.select(path_column, data_column).mapInPandas(run, "path string")
