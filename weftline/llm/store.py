"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get(KEY) or spark.conf.get(KEY, None) or sc.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/weftline/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more. What was made of them has to be written itself."""
    for df in tables:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
            if "/weftline/" in f:
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch that goes to a Python worker; rows alone don't bound it where texts are long.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python workers batches of ``BATCH_BYTES`` (and a row) at most; a smaller bound of the user's stays."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH_KEY, "2147483647")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return df


class Scratch:
    """Written tables that go together, once what was made of them is written itself."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def add(self, df: DataFrame) -> DataFrame:
        self.tables.append(df)
        return df

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        return self.add(written(df, tag))

    def clear(self) -> None:
        discard(*self.tables)
        self.tables = []


def sized(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows, else as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
