"""Removing unpacked directories that duplicate an archive.

* ``cleanup_plan`` -- every archive/directory pair, compared in one job, with a decision.
* ``cleanup_order`` -- one directory may sit next to several archives (``x.zip``, ``x.7z``): the
  first identical pair whose deletion is approved removes it; later pairs find it gone, and so do
  pairs inside a removed directory. Pairs per directory are bounded by the number of archive
  formats, so the per-directory window is small by construction.
* ``cleanup_unpacked`` -- after an organise run: archives moved by a rule with
  ``delete_unpacked_on_match`` are paired (by their original path) with the directory next to them.

Safety: a directory whose listing had hidden entries (not compared) is never auto-removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_archive, name_of, parent_of
from ..functions.rules import to_rules
from ..operators import diff as D
from ..session import cut_lineage
from ..sources.inventory import self_and_ancestors
from .actions import PLANNED
from .decisions import AUTOMATIC, decide

REMOVED, GONE, KEPT, DIFFERENT, HIDDEN, UNREADABLE = "removed", "gone", "kept", "different", "has_hidden", "unreadable"


def compared_pairs(members: DataFrame, dirfiles: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``archive, dir, n_differences, identical, has_hidden`` for every pair."""
    flags = cut_lineage(D.pair_flags(members, dirfiles, pairs))  # a row per pair, read three times below
    diffs = D.compare_listings(members, dirfiles, flags).filter(F.col("kind") != "same")
    n = diffs.groupBy(*D.PAIR).agg(F.count(F.lit(1)).alias("n"))
    out = flags.join(n, D.PAIR, "left").withColumn("n_differences", F.coalesce("n", F.lit(0)).cast("bigint"))
    # an archive that could not be read lists no members: never call it identical
    identical = (F.col("n_differences") == 0) & ~F.col("unreadable")
    out = out.select(*D.PAIR, "n_differences", identical.alias("identical"), "has_hidden", "unreadable")
    return out if "error" in members.columns else out.drop("unreadable")


def cleanup_plan(compared: DataFrame, mode: str = AUTOMATIC, always_delete: bool = False,
                 approved: DataFrame | None = None) -> DataFrame:
    """Decision per pair: delete the directory when identical (and allowed), in pair order."""
    c = compared
    if approved is not None:
        c = c.join(approved.select("archive", "approved"), "archive", "left")
        ok = decide(F.lit("delete"), mode, always_delete, F.col("approved"))
    else:
        ok = decide(F.lit("delete"), mode, always_delete)
    c = c.withColumn("decision", F.col("identical") & ~F.col("has_hidden") & ok)
    return cleanup_order(cut_lineage(c))


def cleanup_order(c: DataFrame) -> DataFrame:
    """Status per pair (W4): ``removed`` / ``gone`` / ``kept`` / ``different`` / ``has_hidden``."""
    w = Window.partitionBy("dir")
    first = F.min(F.when(F.col("decision"), F.col("archive"))).over(w)
    c = c.withColumn("removed_by", first)
    removed_dirs = c.filter(F.col("archive") == F.col("removed_by")).select(F.col("dir").alias("_rd"))
    nested = (c.select("archive", F.explode(self_and_ancestors(parent_of("dir"))).alias("_rd"))
              .join(removed_dirs, "_rd").select("archive").distinct().withColumn("_nested", F.lit(True)))
    c = c.join(nested, "archive", "left")
    unreadable = F.col("unreadable") if "unreadable" in c.columns else F.lit(False)
    status = (F.when(F.coalesce("_nested", F.lit(False)), F.lit(GONE))
              .when(unreadable, F.lit(UNREADABLE))
              .when(F.col("archive") == F.col("removed_by"), F.lit(REMOVED))
              .when(F.col("removed_by").isNotNull() & (F.col("archive") > F.col("removed_by")), F.lit(GONE))
              .when(F.col("identical") & F.col("has_hidden"), F.lit(HIDDEN))
              .when(F.col("identical"), F.lit(KEPT))
              .otherwise(F.lit(DIFFERENT)))
    return c.select("archive", "dir", "n_differences", "identical", "has_hidden", "decision",
                    status.alias("status"), (status == REMOVED).alias("removes"))


def cleanup_summary(plan: DataFrame) -> DataFrame:
    """One row (A4, A9): pairs checked, identical, different, directories removed."""
    return plan.agg(F.count(F.lit(1)).alias("total_pairs"), F.count_if("identical").alias("identical"),
                    F.count_if(~F.col("identical")).alias("different"), F.count_if("removes").alias("deleted"))


def cleanup_unpacked(plan: DataFrame, rules, members: DataFrame, dirfiles: DataFrame,
                     mode: str = AUTOMATIC, always_delete: bool = False) -> DataFrame:
    """Executed moves of archive files whose rule asks for it -> pair with the directory next
    to the *original* archive path -> compare -> decide."""
    flagged = [r.idx for r in to_rules(rules) if r.delete_unpacked_on_match]
    moved = plan.filter(F.col("decision") & (F.col("status") == PLANNED) & (F.col("action_type") == "move")
                        & ~F.col("is_directory") & is_archive("name") & F.col("rule_idx").isin(flagged))
    arch = cut_lineage(moved.select(F.col("path").alias("archive"), "final_path"))
    dirs = dirfiles.select("dir").distinct()
    pairs = D.pair_archives(arch, dirs)
    compared = compared_pairs(members, dirfiles, pairs)
    out = cleanup_plan(compared, mode, always_delete)
    return out.join(arch, "archive").select("archive", "final_path", "dir", "identical", "decision", "status")


def world_members(members: DataFrame, root: str) -> DataFrame:
    return members.withColumn("archive", F.concat(F.lit(root + "/"), F.col("archive")))


def world_dirs(dirfiles: DataFrame, root: str) -> DataFrame:
    return dirfiles.withColumn("dir", F.concat(F.lit(root + "/"), F.col("dir")))


def archive_rows(members: DataFrame) -> DataFrame:
    """Inventory rows for archives known only by their members (size = sum of member sizes)."""
    return (members.groupBy("archive").agg(F.sum("size").alias("size"))
            .select(parent_of("archive").alias("parent"), name_of("archive").alias("name"), "size",
                    F.lit(None).cast("timestamp").alias("mtime"), F.lit(False).alias("is_directory"),
                    F.xxhash64("archive").alias("seq")))


def dir_rows(dirfiles: DataFrame) -> DataFrame:
    """Inventory rows (files and directory entries) of directories given as listings."""
    p = F.concat(F.col("dir"), F.lit("/"), F.regexp_replace("rel", "/$", ""))
    return dirfiles.select(parent_of(p).alias("parent"), name_of(p).alias("name"), "size",
                           F.lit(None).cast("timestamp").alias("mtime"), F.col("rel").endswith("/").alias("is_directory"),
                           F.xxhash64(p).alias("seq"))

