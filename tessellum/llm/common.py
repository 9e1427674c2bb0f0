"""Helpers shared by the corpus operators: table access, lineage cuts, whole-text features."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's setting by which a query deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is made only where no setting names one (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    place = tempfile.mkdtemp(prefix="tessellum-")
    spark.sparkContext.setCheckpointDir(place)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Cut:
    """A frame written as Parquet in the shared folder and read again: its lineage starts at the files.

    Lost executors cost a re-read, not a re-computation. ``drop`` deletes the files once nothing needs them; what is left
    is deleted when the driver ends.
    """

    #: Of the Parquet writer.
    options: dict[str, str] = {}

    def __init__(self, df: DataFrame, name: str = "cut", codec: str = "snappy"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tessellum-{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")  # what was shuffled for these files is not needed once they are written
        try:
            df.write.options(**self.options).option("compression", codec).parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self._file, self._fs = self._place()
        self._fs.deleteOnExit(self._file)  # what nobody drops goes when the driver ends
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def _place(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self) -> None:
        self._fs.delete(self._file, True)
        self._fs.cancelDeleteOnExit(self._file)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    return Cut(df, name).df


def words(text: Column) -> Column:
    """The words of a text, in order; null and white-space-only texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def crc_rest(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written in decimal, modulo ``modulus``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
