"""Sharding (operator 11): a two-pass external shuffle.

1. *Scatter.* Every record goes to a bucket by a seeded hash of its id and text, so a bucket is a
   uniform sample of the corpus and small enough to sit in memory. One aggregate of rows and bytes
   by ``CELLS`` fine hash cells tells how many buckets that takes; a bucket is a run of cells.
2. *Shuffle and write.* Each bucket is gathered whole, put into Fisher-Yates order (the built-in
   ``shuffle``) and written. Bucket after bucket, the records then form one uniform permutation, of
   which a shard is a run: shard sizes in rows differ by one at most (law ``rows``).

The Fisher-Yates draws come from one generator per slice of a ``range`` of bucket numbers, so they
depend on the seed, the number of buckets and their largest size, never on how rows arrive.

Rows that agree in id and text share a hash. Where such copies overfill a bucket, its rows are dealt
anew over all buckets by their place in the input as well, frozen in a written table first. So no
bucket grows with a group of copies or with one id. Only then may a rerun over differently cut files
place those rows otherwise.

Everything is DataFrame functions. Only bounded tables are broadcast, meet a single task or reach the
driver: bucket counts (at most ``CELLS`` rows; summed up in two levels) and a few totals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakerules.llm._common import cut

SEED = 20240611
N_SHARDS = 8
BUCKET_BYTES = 16 << 20  # text bytes of a bucket on average
BUCKET_ROWS = 1 << 15
CELLS = 1 << 20  # also the most buckets
LEAST_BUCKETS = 64
OVERFULL = 4  # times the average
SLICES = 4096  # generators at most
GROUP = 1 << 10  # buckets whose sizes one task sums up


def record_size(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _cell(h: Column) -> Column:
    return F.pmod(h, F.lit(CELLS).cast("long"))


def bucket_count(rows: int, size: int, bucket_bytes: int, bucket_rows: int, least: int) -> int:
    """A power of two, so that a bucket is a run of cells."""
    need = max(math.ceil(size / bucket_bytes), math.ceil(rows / bucket_rows), least, 1)
    return min(CELLS, 1 << (need - 1).bit_length())


def scatter(df: DataFrame, id_name: str, text_name: str, seed: int, bucket_bytes: int, bucket_rows: int,
            least: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows with ``__h`` and ``__bucket``, rows per bucket, and the number of buckets."""
    parts = [F.coalesce(F.col(id_name).cast("string"), F.lit("")), F.coalesce(F.col(text_name), F.lit(""))]
    rows = df.withColumn("__h", F.xxhash64(F.lit(f"shard:{seed}"), *parts)).withColumn("__cell", _cell(F.col("__h")))
    cells = cut(rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"), F.sum(record_size(F.col(text_name))).alias("size")))
    total = cells.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    n, size = total["n"] or 0, total["size"] or 0
    buckets = bucket_count(n, size, bucket_bytes, bucket_rows, least)
    width = CELLS // buckets
    rows = rows.withColumn("__bucket", F.expr(f"__cell div {width}")).drop("__cell")
    counts = cells.groupBy(F.expr(f"__cell div {width}").alias("bucket")).agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"))
    full = (F.col("n") > OVERFULL * max(bucket_rows, n / buckets)) | (F.col("size") > OVERFULL * max(bucket_bytes, size / buckets))
    overfull = cut(counts.filter(full).select(F.col("bucket").alias("__bucket"), F.lit(True).alias("__full")))
    if not overfull.isEmpty():
        placed = rows.withColumn("__place", F.monotonically_increasing_id())
        placed = placed.withColumn("__anew", _cell(F.xxhash64("__h", "__place"))).join(F.broadcast(overfull), "__bucket", "left")
        rows = cut(placed.withColumn("__bucket", F.when(F.col("__full"), F.expr(f"__anew div {width}")).otherwise(
            F.col("__bucket"))).drop("__place", "__anew", "__full"))
        counts = rows.groupBy(F.col("__bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return rows, cut(counts.select("bucket", "n")), buckets


def offsets(counts: DataFrame) -> DataFrame:
    """Rows before each bucket: sums within groups of ``GROUP`` buckets, then over the groups."""
    group = F.expr(f"bucket div {GROUP}")
    inner = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("g", group).withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    groups = counts.groupBy(group.alias("g")).agg(F.sum("n").alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    return local.join(groups.select("g", "base"), "g").select(
        F.col("bucket").alias("__bucket"), "n", (F.col("base") + F.col("before")).alias("base"))


def orders(spark, buckets: int, most: int, seed: int) -> DataFrame:
    """A Fisher-Yates permutation of 0 .. most-1 per bucket. What is left of it below a bucket's own
    size is a uniform permutation of that bucket."""
    index = F.sequence(F.lit(0), F.lit(most - 1))
    return spark.range(0, buckets, 1, min(buckets, SLICES)).select(
        F.col("id").alias("__bucket"), F.shuffle(index, seed).alias("perm"))


def shuffle_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = N_SHARDS,
                   seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS,
                   least_buckets: int = LEAST_BUCKETS) -> DataFrame:
    """All columns of ``df`` by place, then ``shard`` (0 to ``n_shards`` - 1) and ``slot``, gapless
    from 0 within the shard: a uniform permutation cut into runs whose lengths differ by one at most.

    - Null ids and texts count as empty text in the hash; such rows are kept like any other.
    - Rows given twice are records of their own. Rows that agree in id and text but in no more may
      change places with each other.
    - Texts are never split: a bucket holds at least its longest text, whole.
    - Columns of any type and name travel along, also those named ``shard`` or ``slot``; columns
      whose names differ in case only keep theirs. The two new ones come last.
    - With fewer rows than shards the last shards are empty; an empty table gives an empty result.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    names = df.columns
    inner = [f"c{i}" for i in range(len(names))]
    id_name, text_name = inner[names.index(id_col)], inner[names.index(text_col)]
    rows, counts, buckets = scatter(df.toDF(*inner), id_name, text_name, seed, bucket_bytes, bucket_rows, least_buckets)
    total = counts.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    n, most = total["n"] or 0, total["most"] or 0
    if not n:
        return df.sparkSession.createDataFrame([], rows.select(
            *inner, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema).toDF(*names, "shard", "slot")

    # four buckets a task, whatever the session's number of partitions; gathered after the shuffle
    rows = rows.repartition(max(1, buckets // 4), "__bucket")
    held = rows.groupBy("__bucket").agg(F.collect_list(F.struct("__h", *inner)).alias("records"))
    # records in an order that does not depend on arrival, as indices: other columns need no order
    keys = F.transform("records", lambda r, i: F.struct(
        r["__h"].alias("h"), r[id_name].cast("string").alias("id"), F.crc32(r[text_name].cast("binary")).alias("crc"), i.alias("i")))
    held = held.select("__bucket", "records", F.transform(F.sort_array(keys), lambda k: k["i"]).alias("at"))
    plan = orders(df.sparkSession, buckets, most, seed).join(F.broadcast(offsets(counts)), "__bucket").select(
        "__bucket", "base", F.filter("perm", lambda i: i < F.col("n")).alias("perm"))
    dealt = held.join(plan.hint("shuffle_hash"), "__bucket").select(
        "base", F.transform("perm", lambda i: F.get(F.col("records"), F.get(F.col("at"), i))).alias("records"))
    flat = dealt.select("base", F.posexplode_outer("records").alias("pos", "r")).withColumn("p", F.col("base") + F.col("pos"))

    short, longer = divmod(n, n_shards)  # the first `longer` shards hold one row more
    split = longer * (short + 1)
    shard = F.when(F.col("p") < split, F.expr(f"p div {short + 1}"))
    first = F.col("shard") * short + F.least(F.col("shard"), F.lit(longer))
    if short:
        shard = shard.otherwise(F.expr(f"{longer} + (p - {split}) div {short}"))
    flat = flat.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("p") - first).cast("long"))
    return flat.select(*[F.col("r")[c].alias(c) for c in inner], "shard", "slot").toDF(*names, "shard", "slot")


def write_shards(df: DataFrame, path: str, **options) -> DataFrame:
    """Write :func:`shuffle_shards` below ``path`` as Parquet, one folder ``shard=<n>`` per shard with
    files sorted by ``slot``, and return the table that was written. Columns of ``df`` must have
    distinct names other than ``shard`` and ``slot``, as files need them."""
    dealt = shuffle_shards(df, **options)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)
