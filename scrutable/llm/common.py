"""What the operators of this subpackage share: reading tables, shared folders, shipping code."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

_SHIPPED: dict[str, str] = {}
_WRITTEN: dict[int, str] = {}  # where each frame that cut() gave was written


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ship(spark: SparkSession) -> None:
    """Give executors this package, once an application, so that functions are found by name there."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; texts can be long
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(), "scrutable.zip")
    with zipfile.ZipFile(name, "w") as out:
        for folder, _, files in os.walk(root):
            for x in files:
                if x.endswith(".py"):
                    out.write(os.path.join(folder, x), os.path.relpath(os.path.join(folder, x), os.path.dirname(root)))
    sc.addPyFile(name)
    _SHIPPED["app"] = sc.applicationId


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all machines of a cluster share.

    Only a local session may leave the setting out: its one machine gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = _SHIPPED.setdefault("local", "file://" + tempfile.mkdtemp(prefix="scrutable-"))
    return f"{base.rstrip('/')}/scrutable-{uuid.uuid4().hex}"


def cut(df: DataFrame, few: bool = False, by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and lost executors cost nothing before it.

    With `few`, for tables of ids and links, at most two files a core: the partitions of one file are worked
    through one after the other, so memory stays that of a partition. With `by`, in folders of that column's values.
    """
    path = shared_folder(df.sparkSession) + "/part"
    out = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism) if few else df
    (out.write.partitionBy(by) if by else out.write).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[id(written)] = path
    weakref.finalize(written, _WRITTEN.pop, id(written), None)
    return written


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*written: DataFrame) -> None:
    """Delete tables made by `cut` that nothing reads any more; what a result still reads has to stay."""
    for df in written:
        delete(df.sparkSession, _WRITTEN[id(df)].rpartition("/")[0])


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A shuffled join at every size: both sides grow with the corpus, and large keys stay splittable."""
    return left.join(right.hint("merge"), on, how)


def hinted(written: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """A table made by `cut`: to broadcast if its measured bytes are at most `most_bytes`, to shuffle otherwise."""
    wide = [c for c in written.columns if written.schema[c].dataType.simpleString() in ("string", "binary")]
    size = F.count("*") * 8 * len(written.columns)
    for c in wide:
        size = size + F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    return written.hint("broadcast" if written.agg(size).first()[0] <= most_bytes else "merge")
