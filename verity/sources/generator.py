"""Sources made of user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def register_generator(spark: SparkSession, name: str, fn: Callable[[int], Iterable[tuple]], schema: str, partitions: int = 1, available: Callable[[], int] | None = None) -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read the tuples of ``fn(k)`` as block k.

    A read has blocks 0 .. ``partitions`` - 1. A stream has the blocks from its last offset to the number that ``available`` gives then (by default ``partitions``), one task
    a block; offsets are kept in the stream's checkpoint. ``fn`` must give the same for a block each time, as a batch that is tried
    again, or a stream that is started again, reads its blocks anew.
    """

    class Part(InputPartition):
        def __init__(self, k: int):
            self.k = k

    class Reader(DataSourceReader):
        def partitions(self):
            return [Part(k) for k in range(partitions)]

        def read(self, partition):
            yield from fn(partition.k)

    class Stream(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"block": 0}

        def latestOffset(self) -> dict:
            return {"block": available() if available else partitions}

        def partitions(self, start: dict, end: dict):
            return [Part(k) for k in range(start["block"], end["block"])]

        def read(self, partition):
            yield from fn(partition.k)

        def commit(self, end: dict) -> None: ...

    class Source(DataSource):
        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

        def streamReader(self, schema):
            return Stream()

    Source.name = classmethod(lambda cls: name)
    spark.dataSource.register(Source)
