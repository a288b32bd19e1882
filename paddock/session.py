"""What operators need of a session: the package on the workers, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the plans rely on.

    Unions don't claim their inputs' partitioning: with partitions coalesced at run time, inputs of
    unequal counts would be zipped, which fails.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application."""
    prepare(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="paddock-")) / "paddock_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary one; on a cluster a folder of the
    driver's own would be written by executors and read by nobody.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = held or tempfile.mkdtemp(prefix="paddock-")
        if not held:
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def spread(df: DataFrame, *by: str, each: int | None = None) -> DataFrame:
    """``df`` by the columns over enough partitions for every core, whatever the bytes.

    Partitions that Spark sizes itself follow the bytes; of small files that Python goes through one by one,
    a few megabytes are the work of all cores. With ``each``, rows are counted, and partitions hold about as many at most.
    """
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if each:
        n = max(n, -(-df.count() // each))
    return df.repartition(n, *by)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The tables stay, as results are read from them lazily; whoever owns the shared folder clears it when
    the application has ended.
    """
    path = f"{shared_dir(prepare(df.sparkSession))}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
