"""Session helpers shared by every job."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for an application, so that they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="shelfspark-package-")) / "shelfspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the Parquet tables below ``sf_dir``."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores (and at least as many tasks as a shuffle has), for costly work on rows of few bytes: a file of 4 MB is one task's otherwise, whatever its rows cost."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def dealt_over(cells: int) -> int:
    """Partitions for so many cells of work, most of which then have one of their own. A number keeps Spark from joining them by their bytes, which say little of the work."""
    return max(cells, min(8 * cells, 256))


def nothing(kind: str) -> Column:
    """What stands for no value on the way to Python: an empty string or list, null in other types.

    Spark measures a batch after every row, and each time goes through the nulls
    at the end of a column of strings or lists: 10,000 of them in a row cost ten
    times what the rows do.
    """
    return F.array().cast(kind) if kind.startswith("array") else F.lit("") if kind == "string" else F.lit(None).cast(kind)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shelfspark-checkpoint-"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder itself, for tables that a job writes between its steps."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Spark's own setting: a query's shuffle files go when it ends, not when the driver next collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _file_system(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut_lineage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder (or a ``scratch_folder`` there) and go on from the written copy.

    Unlike checkpoint(), a table that is read again has the size of its files as
    its statistics. A checkpoint keeps its plan's estimate, which the joins of an
    iterative job multiply until it fills the driver. The shuffle files of the
    write go with it, as nothing reads them again. The file system deletes the
    table when the application ends.
    """
    spark = df.sparkSession
    path = f"{folder or checkpoint_folder(spark)}/table-{uuid.uuid4()}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    if folder is None:
        _file_system(spark, _path(spark, path)).deleteOnExit(_path(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, for tables that ``drop_folder`` deletes before the application ends."""
    name = f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4()}"
    _file_system(spark, _path(spark, name)).deleteOnExit(_path(spark, name))
    return name


def drop_folder(spark: SparkSession, name: str) -> None:
    """Delete a ``scratch_folder``; what was made from its tables must be written by now."""
    _file_system(spark, _path(spark, name)).delete(_path(spark, name), True)


def read_finished(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table at ``path`` if its write came to its end, else None."""
    mark = _path(spark, f"{path}/_SUCCESS")
    return spark.read.schema(schema).parquet(path) if _file_system(spark, mark).exists(mark) else None


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, in order; none if there is no such folder."""
    place = _path(spark, path)
    files = _file_system(spark, place)
    if not files.exists(place):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(place) if f.isDirectory())
