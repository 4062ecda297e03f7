"""Small files and folders through Hadoop's file systems, so that any store Spark reaches will do."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str, sync: bool = True) -> None:
        """Write a file whole and move it into place, so that readers see the old or the new one."""
        fs, p = self._at(path)
        _, temporary = self._at(path + ".tmp")
        stream = fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        if sync:
            stream.hsync()
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, p, options)


def checkpoint_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, which the cluster sets; only a local session may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return spark.conf.get("spark.checkpoint.dir")


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and cut from their lineage."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)
