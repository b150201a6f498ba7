"""Where intermediate tables go.

A job that reads one intermediate result several times writes it to the folder that the cluster names in
``spark.checkpoint.dir`` and reads it back: the lineage is cut and a lost executor takes nothing with it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode, where none is set, a folder of this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back from there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_delivery(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of ``keys``: of several, the one whose other columns are smallest.

    Only rows whose keys come again are grouped; all others pass as they are, without being sorted by their content.
    Rows without a key go."""
    rest = [c for c in df.columns if c not in keys]
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    chosen = df.join(again, list(keys), "left_semi").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
    return df.join(again, list(keys), "left_anti").select(*df.columns).unionByName(chosen)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
