"""Frames of recordings as a Spark data source, with a pluggable decoder.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)  # `spindrift.session` does so
    spark.dataSource.register(FrameSource)
    spark.read.format("frames").option("decoder", "package.module:function").option("paths", "a,b").load()

A decoder is a function (path, step, wanted) that yields (frame_idx, fps, uint8 array of height x width x
3 in BGR order); it decodes only frames whose index is a multiple of step, or is in `wanted` if that is
given. Filters on frame_idx (equality, IN) and video_id reach the source. The default decoder draws a
synthetic recording of pages turning, for tests: "synthetic:<seed>:<frames>".
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

SCHEMA = "video_id string, frame_idx long, t_sec double, height int, width int, nChannels int, data binary"


def synthetic(path: str, step: int = 1, wanted: frozenset[int] | None = None) -> Iterator[tuple[int, float, np.ndarray]]:
    """Sixty frames (two seconds) to a page: bright with few or many dark lines, dim and shifted while it turns."""
    _, seed, count = path.split(":")
    for i in range(int(count)):
        if i % step or (wanted is not None and i not in wanted):
            continue
        rng = np.random.default_rng([int(seed), i // 60])
        page = np.full((48, 64, 3), 225, np.uint8)
        for row in rng.choice(np.arange(4, 44), 18 if i // 60 % 2 else 5, replace=False):
            page[row, 6 : 6 + int(rng.integers(20, 52))] = 40
        turn = i % 60 >= 45
        yield i, 30.0, np.roll(page, 12, axis=1) // 2 if turn else page


def decoder(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class Recording(InputPartition):
    def __init__(self, path: str, wanted: frozenset[int] | None) -> None:
        self.path, self.wanted = path, wanted


class FrameReader(DataSourceReader):
    """One partition for each recording: frames of one can only be decoded in order."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [x for x in options.get("paths", "").split(",") if x]
        self.step = int(options.get("step", 1))
        self.decoder = options.get("decoder", "spindrift.sources.frames:synthetic")
        self.wanted: frozenset[int] | None = None

    def pushFilters(self, filters: Sequence) -> Iterator:
        for f in filters:
            column, values = getattr(f, "attribute", None), None
            if isinstance(f, EqualTo):
                values = {f.value}
            elif isinstance(f, In):
                values = set(f.value)
            if values is not None and column == ("frame_idx",):
                self.wanted = frozenset(values) if self.wanted is None else self.wanted & values
            elif values is not None and column == ("video_id",):
                self.paths = [x for x in self.paths if x in values]
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Recording(x, self.wanted) for x in self.paths]

    def read(self, partition: Recording) -> Iterator[tuple]:
        for i, fps, image in decoder(self.decoder)(partition.path, self.step, partition.wanted):
            yield partition.path, i, i / fps, image.shape[0], image.shape[1], image.shape[2], image.tobytes()


class FrameStream(DataSourceStreamReader):
    """Micro-batches of whole recordings: scores need a recording's end."""

    def __init__(self, options: dict[str, str]) -> None:
        self.reader = FrameReader(options)
        self.each = int(options.get("recordingsPerBatch", 1))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"recordings": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.at + self.each, len(self.reader.paths))
        return {"recordings": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Recording(x, None) for x in self.reader.paths[start["recordings"] : end["recordings"]]]

    def read(self, partition: Recording) -> Iterator[tuple]:
        return self.reader.read(partition)


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(self.options)
