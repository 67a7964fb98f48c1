"""What the operators share: choosing columns, passing rows through, cutting lineage."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A whole table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def place(columns: list[str], name: str) -> int:
    """Position of the column called exactly ``name``, else of the first that differs only in case."""
    if name in columns:
        return columns.index(name)
    lowered = [c.lower() for c in columns]
    if name.lower() not in lowered:
        raise ValueError(f"there is no column {name!r} among {columns}")
    return lowered.index(name.lower())


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, as ``new=old``; other columns may have any names, even the same ones."""
    at = {new: place(df.columns, old) for new, old in wanted.items()}
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{i}").alias(new) for new, i in at.items()))


def numbered(df: DataFrame) -> DataFrame:
    """The same rows under the names c0, c1, ... which clash with nothing."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in spark.checkpoint.dir. Where none is named, a temporary one serves a
    driver that runs its tasks itself; on a cluster, where executors wouldn't share it, that is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rillstone-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """Computes ``df`` now and cuts its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
