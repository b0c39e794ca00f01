"""Adapters: the driver's parquet tables seen as file inventories, archive members, answers.

Each adapter is a plain projection of one table (no shuffle), so scans keep column pruning and
predicate pushdown. The same shapes are written as SQL in :mod:`lakerules.oracle` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sf_path

# Reference instants the adapters' ages are measured from.
INV_AS_OF = "2024-01-31"
INVL_AS_OF = "2002-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


def _s(c) -> F.Column:
    return c.cast("string")


def inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INV: events as files under /data/<type>/u<user>; every 17th hidden, five extensions."""
    return inv_from_events(table(spark, sf_dir, "events"))


def inv_from_events(e: DataFrame) -> DataFrame:
    """The INV projection of an events DataFrame (batch or streaming)."""
    ext = (F.when(e.event_id % 5 == 0, ".log").when(e.event_id % 5 == 1, ".zip")
           .when(e.event_id % 5 == 2, ".TMP").when(e.event_id % 5 == 3, ".csv").otherwise(""))
    return e.select(
        F.concat(F.lit("/data/"), e.event_type, F.lit("/u"), _s(e.user_id)).alias("parent"),
        F.concat(F.when(e.event_id % 17 == 0, ".").otherwise(""), e.event_type, F.lit("_"), _s(e.event_id), ext).alias("name"),
        F.floor(e.value * 1048576).cast("bigint").alias("size"),
        e.ts.cast("timestamp").alias("mtime"),
        F.lit(False).alias("is_directory"),
        e.event_id.alias("seq"),
    )


def invl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INVL: lineitem as files (the benchmark inventory)."""
    l = table(spark, sf_dir, "lineitem")
    ext = (F.when(l.l_partkey % 4 == 0, ".parquet").when(l.l_partkey % 4 == 1, ".tmp")
           .when(l.l_partkey % 4 == 2, ".zip").otherwise(""))
    return l.select(
        F.concat(F.lit("/"), l.l_returnflag, F.lit("/s"), _s(l.l_suppkey)).alias("parent"),
        F.concat(F.lit("o"), _s(l.l_orderkey), F.lit("_"), _s(l.l_linenumber), ext).alias("name"),
        F.floor(l.l_extendedprice * 100).cast("bigint").alias("size"),
        l.l_shipdate.cast("timestamp").alias("mtime"),
        F.lit(False).alias("is_directory"),
        (l.l_orderkey * 8 + l.l_linenumber).alias("seq"),
    )


def claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLAIM: parts as files with natural name collisions; seq % 4 = 0 already present."""
    p = table(spark, sf_dir, "part")
    return p.select(p.p_brand.alias("parent"),
                    F.concat(F.regexp_replace(p.p_name, " ", "_"), F.lit(".dat")).alias("name"),
                    p.p_partkey.alias("seq"))


def mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM: conversations as archive members (root prefix, missing turns, wrong sizes, dir entries);
    ``pos`` is the member's place in the archive (directory entries first)."""
    c = table(spark, sf_dir, "conversations")
    root = F.when(c.conv_id % 4 == 0, F.concat(F.lit("conv_"), _s(c.conv_id), F.lit("/"))).otherwise("")
    archive = F.concat(F.lit("conv_"), _s(c.conv_id), F.lit(".zip"))
    files = (c.filter(~((c.conv_id % 5 == 0) & (c.turn == 0)))
             .select(archive.alias("archive"),
                     F.concat(root, c.role, F.lit("/t"), _s(c.turn), F.lit(".txt")).alias("member"),
                     (F.length(c.text) + F.when(c.conv_id % 7 == 0, 1).otherwise(0)).cast("bigint").alias("size"),
                     c.turn.alias("pos")))
    dirs = (c.filter(c.conv_id % 6 == 0)
            .select(archive.alias("archive"), F.concat(root, c.role, F.lit("/")).alias("member"),
                    F.lit(0).cast("bigint").alias("size"), F.lit(-1).cast("bigint").alias("pos")).distinct())
    return files.unionByName(dirs)


def dirfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIR: the unpacked side (two thirds of the conversations, some with a file removed)."""
    c = table(spark, sf_dir, "conversations")
    d = F.concat(F.lit("conv_"), _s(c.conv_id))
    files = (c.filter((c.conv_id % 3 != 1) & ~((c.conv_id % 8 == 0) & (c.turn == 1)))
             .select(d.alias("dir"), F.concat(c.role, F.lit("/t"), _s(c.turn), F.lit(".txt")).alias("rel"),
                     F.length(c.text).cast("bigint").alias("size")))
    dirs = (c.filter(c.conv_id % 3 != 1)
            .select(d.alias("dir"), F.concat(c.role, F.lit("/")).alias("rel"), F.lit(0).cast("bigint").alias("size"))
            .distinct())
    return files.unionByName(dirs)


def conv_root(conv_id) -> F.Column:
    """Directory of a conversation in the nested world: seven of them, half two levels deeper."""
    return F.concat(F.lit("/data/conv/"), _s(conv_id % 7), F.when(conv_id % 2 == 1, "/deep/er").otherwise(""))


def conv_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM under the directories of the nested world; every ninth archive also as ``.7z``."""
    m = mem(spark, sf_dir)
    n = F.regexp_extract("archive", r"conv_(-?[0-9]+)[.]", 1).cast("bigint")
    m = m.withColumn("archive", F.concat(conv_root(n), F.lit("/"), F.col("archive"))).withColumn("_n", n)
    twin = m.filter("_n % 9 = 0").withColumn("archive", F.regexp_replace("archive", r"\.zip$", ".7z"))
    return m.unionByName(twin).drop("_n")


def conv_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONVW: files only. The conversation archives and, two thirds of them, unpacked beside them;
    unpacked files have a time, archives none."""
    c = table(spark, sf_dir, "conversations")
    files = c.filter((c.conv_id % 3 != 1) & ~((c.conv_id % 8 == 0) & (c.turn == 1))).select(
        F.concat(conv_root(c.conv_id), F.lit("/conv_"), _s(c.conv_id), F.lit("/"), c.role).alias("parent"),
        F.concat(F.lit("t"), _s(c.turn), F.lit(".txt")).alias("name"), F.length(c.text).cast("bigint").alias("size"),
        F.timestamp_seconds(F.lit(1700000000) + c.conv_id * 100 + c.turn).alias("mtime"))
    archives = (conv_members(spark, sf_dir).groupBy("archive").agg(F.sum("size").alias("size"))
                .select(F.regexp_extract("archive", "^(.*)/[^/]*$", 1).alias("parent"),
                        F.regexp_extract("archive", "[^/]*$", 0).alias("name"), "size", F.lit(None).cast("timestamp").alias("mtime")))
    return files.unionByName(archives).withColumn("is_directory", F.lit(False))


def conv_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the clean-up prompts of the nested world, by archive."""
    archives = conv_members(spark, sf_dir).select(F.col("archive").alias("id")).distinct()
    n = F.regexp_extract("id", r"conv_(-?[0-9]+)[.]", 1).cast("bigint")
    resp = (F.when(n % 29 == 3, "never").when(n % 23 == 5, "a").when(n % 4 == 2, "n").when(n % 5 == 0, "maybe").otherwise(""))
    return archives.select("id", resp.alias("resp"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TREE: page URLs as paths; a trailing '/' marks a directory entry."""
    p = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(p.url, r"^https?://", ""), r"[?#].*$", ""))
    return p.select(path.alias("path"), F.length(p.html).cast("bigint").alias("size"), p.page_id.alias("seq"))


def txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT: whole document texts as names, in NFC and in a decomposed form."""
    d = table(spark, sf_dir, "documents")
    name = d.text
    return d.select(d.doc_id.alias("seq"), F.concat(F.lit("/"), d.source, F.lit("/"), d.lang).alias("parent"),
                    name.alias("name_nfc"), F.replace(name, F.lit("\u00e9"), F.lit("e\u0301")).alias("name_nfd"),
                    d.n_chars.alias("size"))


def appr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APPR: answers to delete prompts, keyed by event type, in event order."""
    e = table(spark, sf_dir, "events")
    resp = (F.when(e.event_id % 97 == 3, "never").when(e.event_id % 89 == 5, "a")
            .when(e.event_id % 2 == 0, "n").otherwise(""))
    return e.select(e.event_id.alias("id"), e.event_type.alias("key"), resp.alias("resp"))


# Fixed rule rows of the RULES adapter (one rule set, flattened to one condition per row).
RULES_ROWS = [
    (0, "old tmp", "end", ".tmp", "delete", None), (0, "old tmp", "older", "7d", "delete", None),
    (1, "big zips", "regex", "(?:click|view)_[0-9]+[.]zip$", "move", "archives"),
    (1, "big zips", "larger", "100MB", "move", "archives"),
    (2, "errors", "start", "error", "compress", "errs"), (2, "errors", "newer", "2w", "compress", "errs"),
    (3, "", "bigger", "1XB", "shred", None), (4, None, "larger", "1.5.5GB", "move", None),
    (5, "up", "start", "x", "move", "../x"),
]


def rules_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RULES x tenants: the rule rows repeated for every document source (a tenant)."""
    tenants = table(spark, sf_dir, "documents").select(F.col("source").alias("ruleset")).distinct()
    return tenants.select("ruleset", F.inline(rules_literal()))


def rules_literal() -> F.Column:
    """The fixed rule rows as an array<struct> literal (generated per tenant, no join needed)."""
    def lit(v, t):
        return F.lit(v).cast(t)
    return F.array(*[F.struct(lit(i, "int").alias("rule_idx"), lit(n, "string").alias("name"),
                              lit(k, "string").alias("cond_key"), lit(v, "string").alias("cond_value"),
                              lit(a, "string").alias("action_type"), lit(t, "string").alias("target"))
                     for i, n, k, v, a, t in RULES_ROWS])
