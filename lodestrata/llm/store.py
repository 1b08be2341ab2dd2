"""Stage tables in the folder that the cluster shares.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a task retry and never a lost block.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one is set only where the session names none and has no other machines (tests)."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table that was written; its shuffle files go at once."""
    return rounds([df], name, **options)


def rounds(parts: Iterable[DataFrame], name: str, **options: str) -> DataFrame:
    """One table of all ``parts`` (one at least, of one schema), written one after another: the shuffle files of each go before the next."""
    path = ""
    for df in parts:
        path, conf = path or new_path(df.sparkSession, name), df.sparkSession.conf
        before = conf.get(_CLEAN)
        conf.set(_CLEAN, "true")
        try:
            df.write.mode("append").options(**options).parquet(path)
        finally:
            conf.set(_CLEAN, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def in_turns(rows: DataFrame, n: int, at_once: int, *by: str) -> Iterator[DataFrame]:
    """``rows`` in parts by a hash of the columns ``by``, as many as keep ``n`` rows to about ``at_once`` a part."""
    turns = max(1, -(-n // at_once))
    for k in range(turns):
        # the literal makes this hash another than that of partitions
        yield rows if turns == 1 else rows.filter(F.pmod(F.xxhash64(*by, F.lit("turn")), F.lit(turns)) == k)


def drop(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_stage_path", None):
            delete(t.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list:
    """The columns of ``df`` by name, whatever signs the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_batches(df: DataFrame, run, schema: StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for column names with any signs; ``run`` sees and gives the real names."""
    names, made = df.columns, schema.names

    def renamed(batches):
        for out in run(b.rename_columns(names) for b in batches):
            yield out.rename_columns([f"c{k}" for k in range(len(made))])

    safe = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema.fields)])
    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(renamed, safe).toDF(*made)
