"""Rule matching on a stream of arriving inventory rows.

Rows are matched inside ``foreachBatch``, at the instant of their micro-batch. That instant is
written down before the rows are, in a table of epochs, and a micro-batch that runs again after a
failure reads it from there: it gives the same rows, into the same folder. So ages are those of
the first attempt and no row is added twice.

``as_of`` given: all micro-batches have that instant. ``as_of`` None: each has the time at which it
first started.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import as_of_micros
from ..operators.match import match_rules
from ..session import checkpoint_dir

EPOCHS = "epoch long, as_of long"


def read_epochs(spark: SparkSession, base: str) -> DataFrame:
    """``epoch, as_of`` (microseconds): the micro-batches begun, each once."""
    return spark.read.schema(EPOCHS).json(os.path.join(base, "epochs"), recursiveFileLookup=True)


def epoch_instant(spark: SparkSession, base: str, epoch: int, as_of=None, now: Callable[[], int] | None = None) -> int:
    """The instant of a micro-batch: the one recorded, else ``as_of`` or the clock, recorded now."""
    folder = os.path.join(base, "epochs", f"at={epoch}")
    clock = now or (lambda: as_of_micros(datetime.now(timezone.utc)))
    # "ignore" leaves a finished record alone, and the record is read back either way
    given = as_of_micros(as_of) if as_of is not None else clock()
    row = spark.createDataFrame([(epoch, given)], EPOCHS).coalesce(1)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, "_SUCCESS"))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    row.write.mode("ignore" if files.exists(path) else "overwrite").json(folder)
    return spark.read.schema(EPOCHS).json(folder).first()["as_of"]


def append_epoch(batch: DataFrame, epoch: int, base: str, to_inventory: Callable[[DataFrame], DataFrame], rules,
                 as_of=None, now: Callable[[], int] | None = None) -> None:
    """Match one micro-batch and write its rows to ``table/batch=<epoch>``, overwriting an earlier try."""
    spark = batch.sparkSession
    instant = epoch_instant(spark, base, epoch, as_of, now)
    matched = match_rules(to_inventory(batch), rules, instant, spark=spark)
    matched.write.mode("overwrite").parquet(os.path.join(base, "table", f"batch={epoch}"))


def match_stream(spark: SparkSession, source_dir: str, schema, to_inventory: Callable[[DataFrame], DataFrame],
                 rules, as_of=None, out_dir: str | None = None, glob: str = "*.parquet",
                 max_files_per_trigger: int = 1, with_epoch: bool = False) -> DataFrame:
    """Run the stream to completion (``availableNow``) and return the appended plan table; with
    ``with_epoch`` also ``epoch`` and ``as_of`` (microseconds) of each row's micro-batch.

    ``out_dir`` defaults to a folder under the session's checkpoint directory, which on a
    cluster is the shared, durable location (the stream's own checkpoint lives there too). A run
    with the same source, rules and instant goes on where the last one ended. A source without
    files gives no rows.
    """
    tag = hashlib.sha1(f"{source_dir}|{glob}|{rules!r}|{as_of!r}".encode()).hexdigest()[:16]
    base = out_dir or os.path.join(checkpoint_dir(spark), f"match_stream_{tag}")
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    q = (stream.writeStream
         .foreachBatch(lambda batch, epoch: append_epoch(batch, epoch, base, to_inventory, rules, as_of))
         .option("checkpointLocation", os.path.join(base, "_checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    empty = match_rules(to_inventory(spark.createDataFrame([], schema)), rules, as_of or 0, spark=spark)
    table = os.path.join(base, "table")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return empty.selectExpr("*", "0L epoch", "0L as_of") if with_epoch else empty
    rows = (spark.read.schema(empty.schema.add("batch", "long")).option("basePath", table).parquet(table)
            .withColumnRenamed("batch", "epoch"))
    return rows.join(read_epochs(spark, base), "epoch") if with_epoch else rows.drop("epoch")
