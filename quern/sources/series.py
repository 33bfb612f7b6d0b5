"""A table-valued module: an integer series as a Python data source, read in parallel slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Slice(InputPartition):
    def __init__(self, start: int, stop: int, step: int):
        self.start, self.stop, self.step = start, stop, step


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.at = range(int(options.get("start", "0")), int(options["stop"]), int(options.get("step", "1")))
        self.slices = int(options.get("slices", "4"))

    def partitions(self):
        size = -(-len(self.at) // self.slices) or 1
        parts = [self.at[i : i + size] for i in range(0, len(self.at), size)]
        return [_Slice(p.start, p.stop, p.step) for p in parts] or [_Slice(0, 0, 1)]

    def read(self, partition):
        import pyarrow as pa

        values = range(partition.start, partition.stop, partition.step)
        for i in range(0, len(values), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(values[i : i + 65536], pa.int64())], names=["value"])


class SeriesSource(DataSource):
    """``spark.read.format("quern_series").option("start", ..).option("stop", ..).option("step", ..)``"""

    @classmethod
    def name(cls):
        return "quern_series"

    def schema(self):
        return "value bigint"

    def reader(self, schema):
        return _Reader(self.options)


def series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    spark.dataSource.register(SeriesSource)
    return spark.read.format("quern_series").option("start", start).option("stop", stop).option("step", step).load()
