"""Folders of Parquet tables as a source of queries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.files import Files


class ParquetFolder(Mapping):
    """The tables `<folder>/<name>.parquet`, each read when first named; only Spark touches the store."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.read = spark, folder.rstrip("/"), {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.read:
            if name not in self:
                raise KeyError(name)
            self.read[name] = self.made(name)
        return self.read[name]

    def made(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __contains__(self, name: object) -> bool:
        return name in self.read or Files(self.spark).exists(self.path(str(name)))

    def __iter__(self) -> Iterator[str]:
        return iter(n.removesuffix(".parquet") for n in Files(self.spark).list(self.folder) if n.endswith(".parquet"))

    def __len__(self) -> int:
        return sum(1 for _ in self)
