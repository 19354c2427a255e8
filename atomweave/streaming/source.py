"""A trajectory file that is still written to, as a stream of its frames."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.trajectories import RANGE, SCHEMA, complete_until, format_of, frame_table, frames_at

ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t]) for n, t in (f.split() for f in SCHEMA.split(", "))])


@dataclass
class Bytes(InputPartition):
    begin: int
    end: int


class TrajectorySource(DataSource):
    """``spark.readStream.format("trajectory").option("path", FILE).load()``: rows as of the batch reader.

    Options: ``path``, ``box`` (three numbers with commas, for XYZ files), ``kind`` (else by the file's name), ``range`` (bytes of a task).
    Offsets are bytes of the file: a batch is whatever frames have become whole since the last one, an unfinished frame waits.  As no batch reads what is
    before it, ``frame`` is the byte at which a frame begins; it rises with time as frame numbers do.
    """

    @classmethod
    def name(cls) -> str:
        return "trajectory"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TrajectoryStream:  # noqa: N802
        return TrajectoryStream(self.options)


class TrajectoryStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.kind = options.get("kind") or format_of(self.path)
        self.box = [float(v) for v in options.get("box", "0,0,0").split(",")]
        self.range = int(options.get("range", RANGE))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"byte": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"byte": complete_until(self.path, self.kind)}

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        return [Bytes(b, min(b + self.range, end["byte"])) for b in range(start["byte"], end["byte"], self.range)]

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        name = os.path.basename(self.path)
        for at, got in frames_at(self.path, self.kind, self.box, partition.begin, partition.end):
            if got is not None and at < partition.end:
                yield pa.RecordBatch.from_pandas(frame_table(name, at, got), ARROW, preserve_index=False)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TrajectorySource)
