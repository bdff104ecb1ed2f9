"""A Spark data source for NumPy files: `spark.read.format("npy").load(path)` gives (pos, values) of a 1- or 2-dimensional array.

Rows are split over tasks, each of which maps the file and reads its own range only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "pos long, values array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.columns = str(options.get("transposed", "false")).lower() == "true"
        self.rows = int(options.get("rowspertask", 100_000))

    def _array(self) -> np.ndarray:
        a = np.load(self.path, mmap_mode="r")
        if a.ndim == 1:
            a = a.reshape(-1, 1)
        if a.ndim != 2:
            raise ValueError(f"{self.path} has {a.ndim} dimensions; 1 or 2 are read")
        return a.T if self.columns else a

    def partitions(self) -> list[InputPartition]:
        n = len(self._array())
        return [InputPartition((lo, min(n, lo + self.rows))) for lo in range(0, n, self.rows)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        lo, hi = partition.value
        for i, row in enumerate(np.asarray(self._array()[lo:hi], dtype=np.float64), lo):
            yield i, row.tolist()


def edge_index(spark, path: str):
    """(src, dst) from a file of shape (2, edges)."""
    spark.dataSource.register(NpySource)
    if np.load(path.removeprefix("file://"), mmap_mode="r").shape[0] != 2:
        raise ValueError(f"{path} is no edge index: its first dimension is not 2")
    e = spark.read.format("npy").option("transposed", "true").load(path)
    return e.selectExpr("cast(values[0] as long) as src", "cast(values[1] as long) as dst")
