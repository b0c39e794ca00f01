"""Helpers shared by the operators: column picking, lineage cuts, word counts, sampling keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD_GAPS = r"[\x20\x09-\x0D]+"

_cuts: list[tuple[SparkSession, str]] = []
_scratch: list[str] = []


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Exactly the columns asked for, under the names asked for: ``pick(df, id="doc_id")``.

    Columns are found by their exact name, the first of that name, and taken by position. Other
    columns, also ones that differ from these in case only or that bear internal names, neither
    clash nor travel along.
    """
    names = df.columns
    at = {new: names.index(old) for new, old in wanted.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A scratch folder stands in only on a local master,
    where one machine runs everything; on a cluster without the setting this raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _scratch:
        _scratch.append(tempfile.mkdtemp(prefix="llm-cuts-"))
    return _scratch[0]


def new_path(spark: SparkSession, kind: str = "llm") -> str:
    """A folder of the shared folder for one table, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if not _cuts:
        atexit.register(_drop_cuts)
    _cuts.append((spark, path))
    return path


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Later readers neither recompute what lies before it nor need the executors that made it. The
    tables are removed when the driver ends. With ``tidy`` the shuffle files of this write go as soon
    as it ends; the session's own setting comes back after it.
    """
    spark = df.sparkSession
    path = new_path(spark)
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(TIDY)
        elif tidy:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def _drop_cuts() -> None:
    for spark, path in _cuts:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has gone; whoever owns the checkpoint folder clears it
            return


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for a null text."""
    return F.size(F.array_remove(F.split(text_or_empty(text), WORD_GAPS), "")).cast("long")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts without other letters take the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc(key: Column) -> Column:
    """CRC-32 of the key written as text; null keys count as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def uniform(seed: str, *keys: Column) -> Column:
    """A number in (0, 1) from the seed and keys: the first 52 bits of their MD5, the same in any
    engine and run."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
