"""Session helpers shared by all operators: table loading, lineage cuts and skew-aware joins."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="lexiloom-")) / "lexiloom.zip"  # read by the driver, which serves it to the executors
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("lexiloom") / f.relative_to(root))
    spark.sparkContext.addPyFile(str(where))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` (a file or a folder of parts) below sf_dir."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir of the session).

    Only a local session without one, as in tests, gets a temporary folder; on a cluster its absence is an error,
    since a machine-local folder would not outlive its machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="lexiloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a compressed table in the shared folder; smaller than a checkpoint and read by column."""
    where = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(where)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def clear_stored(spark: SparkSession) -> int:
    """Delete the tables that stored() wrote for this application, once their results are no longer read; how many there were."""
    where = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for w in where:
        path = jvm.org.apache.hadoop.fs.Path(w)
        path.getFileSystem(conf).delete(path, True)
    return len(where)


def heavy_keys(counts: DataFrame, key: str, n: str, least: int) -> list:
    """Every key with at least `least` rows of a pre-aggregated (key, n) table.

    There are at most rows / least of them, so that no hot key is left out and the list stays small for the thresholds used.
    """
    return [r[0] for r in counts.where((F.col(n) >= least) & F.col(key).isNotNull()).select(key).collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, heavy: list, how: str = "left") -> DataFrame:
    """Join `left` to `right` (at most one row per key) without sending a hot key to one task.

    Rows of the heavy keys meet a broadcast of at most len(heavy) right rows; all other rows
    take a shuffle join. Both parts together are the whole join.
    """
    if not heavy:
        return left.join(right, key, how)
    hot = F.col(key).isin(heavy)
    cold = left.where(~hot | F.col(key).isNull()).join(right.where(~hot), key, how)
    return left.where(hot).join(F.broadcast(right.where(hot)), key, how).unionByName(cold)


def utrim(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
