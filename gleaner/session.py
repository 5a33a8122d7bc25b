"""A Spark session with the settings that the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_own: dict[str, str] = {}


def session(name: str = "gleaner", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; in local mode one of our own will do."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="gleaner-")
        path = _own[app]
    return f"{path}/gleaner/{uuid.uuid4().hex}"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows: Spark knows so when it plans, so joins with it and exchanges for them fall away, and no Python worker starts."""
    fields = T.StructType.fromDDL(schema).fields
    return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table that Spark knows when it plans: no job and no Python worker reads them."""
    if not rows:
        return empty(spark, schema)
    fields = T.StructType.fromDDL(schema)
    arrays = [pa.array(list(x), to_arrow_type(f.dataType)) for f, x in zip(fields.fields, zip(*rows))]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, fields.names), fields)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def erase(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once all that was made of them has been written too."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
