"""Exact duplicates (operator 9), with DataFrame functions only.

Texts are grouped by the leading 128 bits of the SHA-256 of their folded form *and* by their
bytes, so the hash spreads the work and the grouping itself compares bytes: two texts that share
a hash by accident still end in different groups. The grouping combines on the map side, so a
group holding a third of all rows sends one row per task. Only narrow rows are joined back, and
only with groups of two or more, as a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakerules.llm._common import cut, fold_ascii, pick, text_or_empty

KEY_HEX = 32  # 128 bits


def _keyed(df: DataFrame, id_col: str, text_col: str, normalise, key_hex: int) -> DataFrame:
    rows = pick(df, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", normalise(text_or_empty("text")).alias("norm"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    return rows.withColumn("hash", F.substring("text_sha256", 1, key_hex))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                 normalise=fold_ascii, key_hex: int = KEY_HEX) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` says which id of a group stays: ``"min"``, the smallest stable id, or ``"max"``.

    - Null texts count as empty; empty texts are equal to each other.
    - Null ids never stay while their group has another id. In a group of null ids only,
      ``keep_id`` is null and one row stays.
    - A row given twice (same id, same text) is in its group twice and one of the two stays.
    - An empty table gives an empty result; other columns are not read.
    """
    pick_id = {"min": F.min, "max": F.max}[keep]
    keyed = _keyed(df, id_col, text_col, normalise, key_hex)
    groups = keyed.groupBy("hash", "norm").agg(
        pick_id("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
        F.first("text_sha256").alias("sha"))
    # Narrow from here: within its 128-bit hash, a group of equal bytes goes by its full SHA-256,
    # so different texts that share the shorter hash keep apart in the join as well.
    table = cut(groups.filter("group_size > 1").select("hash", "sha", "keep_id", "group_size"))
    rows = keyed.select("doc_id", "text_sha256", "hash")
    return _decide(rows, table)


def _decide(rows: DataFrame, groups: DataFrame) -> DataFrame:
    # Rows of one id and text are told apart before the join, whose skewed side can then be split.
    nth = F.row_number().over(W.partitionBy("hash", "text_sha256", "doc_id").orderBy("doc_id"))
    rows = rows.withColumn("nth", nth)
    found = rows.join(
        groups, (rows["hash"] == groups["hash"]) & (rows["text_sha256"] == groups["sha"]), "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256")
