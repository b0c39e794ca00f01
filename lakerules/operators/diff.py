"""Archive vs. directory structure comparison.

All pairs are compared in one job: the archive side (members with the archive's own root folder
stripped, names in NFC) and the directory side (its listing, hidden entries pruned) meet in a
one aggregate keyed by (archive, dir, name) over the tagged union of the sides, or, as separate
operators, in a full outer join on that key. Keying by the *name* as well as the pair means a pair
with millions of entries is spread over many tasks: there is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_archive, name_of, nfc, parent_of, percentage, stem_of
from ..functions.conditions import no_hidden_component

PAIR = ["archive", "dir"]
KEY = PAIR + ["rel"]
# Difference kinds, in the order they are reported, and their message prefixes.
KIND_RANK = {"missing": 0, "extra": 1, "size_mismatch": 2}


def pair_archives(archives: DataFrame, dirs: DataFrame) -> DataFrame:
    """Archives (``archive`` path) paired with the directory next to them named as their stem."""
    a = (archives.select("archive").distinct()
         .filter(is_archive(name_of("archive")))
         .select("archive", parent_of("archive").alias("_p"), stem_of(name_of("archive")).alias("_n")))
    d = dirs.select("dir").distinct().select("dir", parent_of("dir").alias("_p"), name_of("dir").alias("_n"))
    return a.join(d, ["_p", "_n"]).select("archive", "dir")


def archive_side(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members of paired archives: root entry dropped, ``<stem>/`` prefix stripped (in NFC).

    Output: ``archive, dir, rel, size, pos, is_dir_entry, nfc_member, root``.
    """
    m = members.join(pairs, "archive")
    root = F.concat(nfc(stem_of(name_of("archive"))), F.lit("/"))
    n = nfc("member")
    if "pos" not in m.columns:
        m = m.withColumn("pos", F.lit(0).cast("bigint"))
    m = m.select(*PAIR, "member", "size", "pos", n.alias("nfc_member"), root.alias("root"))
    rel = (F.when(F.col("nfc_member").startswith(F.col("root")),
                  F.expr("substring(nfc_member, length(root) + 1)"))
           .otherwise(F.col("member")))
    return (m.filter(F.col("nfc_member") != F.col("root"))
            .select(*PAIR, rel.alias("rel"), "size", "pos", "nfc_member", "root",
                    F.col("member").endswith("/").alias("is_dir_entry")))


def has_dirs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: does the archive list sub-directory entries (other than its root)?"""
    m = members.join(pairs, "archive")
    n = nfc("member")
    root = F.concat(nfc(stem_of(name_of("archive"))), F.lit("/"))
    return m.groupBy(*PAIR).agg(F.bool_or(n.endswith("/") & (n != root)).alias("has_dirs"))


def dir_side(dirfiles: DataFrame, pairs: DataFrame, flags: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Directory listing of paired directories; directory entries only when the archive has some."""
    d = dirfiles.join(pairs, "dir").join(flags, PAIR, "left")
    d = d.filter(F.coalesce(F.col("has_dirs"), F.lit(False)) | ~F.col("rel").endswith("/"))
    if not include_hidden:
        d = d.filter(no_hidden_component("rel"))
    return d.select(*PAIR, "rel", "size")


def dedupe_archive(aside: DataFrame) -> DataFrame:
    """One row per NFC name; a name listed twice keeps its last copy (highest ``pos``)."""
    return (aside.withColumn("rel", nfc("rel"))
            .groupBy(*KEY).agg(F.max_by("size", "pos").alias("archive_size"), F.count(F.lit(1)).alias("copies")))


def dedupe_dir(dside: DataFrame) -> DataFrame:
    return (dside.withColumn("key", nfc("rel"))
            .groupBy(*PAIR, "key").agg(F.max_by("size", "rel").alias("dir_size"))
            .withColumnRenamed("key", "rel"))


def sides(members: DataFrame, dirfiles: DataFrame, pairs: DataFrame | None = None):
    """(pairs, archive side keyed by name, directory side keyed by name)."""
    if pairs is None:
        pairs = pair_archives(members, dirfiles)
    flags = has_dirs(members, pairs)
    a = dedupe_archive(archive_side(members, pairs)).drop("copies")
    d = dedupe_dir(dir_side(dirfiles, pairs, flags))
    return pairs, a, d


def same_size():
    """A size that is not known on either side never counts as equal: it must not allow a delete."""
    return F.coalesce(F.col("archive_size") == F.col("dir_size"), F.lit(False))


def compare(a: DataFrame, d: DataFrame) -> DataFrame:
    """Full outer join on (archive, dir, rel) and classify every name."""
    j = a.withColumn("_a", F.lit(True)).join(d.withColumn("_d", F.lit(True)), KEY, "full_outer")
    kind = (F.when(F.col("_a").isNull(), "extra").when(F.col("_d").isNull(), "missing")
            .when(same_size(), "same").otherwise("size_mismatch"))
    return j.select(*KEY, kind.alias("kind"), "archive_size", "dir_size")


def pair_flags(members: DataFrame, dirfiles: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The pairs of :func:`pair_archives` with what is known of each: ``archive, dir, has_dirs`` (the
    archive lists sub-directories), ``has_hidden`` (the directory holds hidden entries), ``unreadable``.
    With ``only`` (``archive, dir``) these pairs, also of archives that list no member.

    One aggregate by (parent, name) over both sides. It combines map-side, and a group holds the
    archives next to one directory that bear its name, at most one per format and spelling.
    """
    is_dir = F.when(F.col("member").endswith("/"), nfc("member") != F.concat(nfc(stem_of(name_of("archive"))), F.lit("/"))).otherwise(False)
    bad = F.col("error").isNotNull() if "error" in members.columns else F.lit(False)
    a = members.filter(is_archive(name_of("archive"))).select(
        parent_of("archive").alias("_p"), stem_of(name_of("archive")).alias("_n"),
        F.struct("archive", F.coalesce(is_dir, F.lit(False)).alias("is_dir"), bad.alias("bad")).alias("entry"),
        F.lit(None).cast("string").alias("dir"), F.lit(False).alias("hidden"))
    if only is not None:
        a = a.unionByName(only.select(
            parent_of("archive").alias("_p"), stem_of(name_of("archive")).alias("_n"),
            F.struct("archive", F.lit(False).alias("is_dir"), F.lit(False).alias("bad")).alias("entry"),
            F.lit(None).cast("string").alias("dir"), F.lit(False).alias("hidden")))
    d = dirfiles.select(parent_of("dir").alias("_p"), name_of("dir").alias("_n"), F.lit(None).cast(a.schema["entry"].dataType).alias("entry"),
                        "dir", (~no_hidden_component("rel")).alias("hidden"))
    both = (a.unionByName(d).groupBy("_p", "_n").agg(F.collect_set("entry").alias("entries"), F.collect_set("dir").alias("dirs"),
                                                     F.bool_or("hidden").alias("has_hidden"))
            .filter((F.size("entries") > 0) & (F.size("dirs") > 0)))
    one = both.select("entries", "has_hidden", F.explode("dirs").alias("dir"), F.transform("entries", lambda e: e["archive"]).alias("names"))
    one = one.select("entries", "has_hidden", "dir", F.explode(F.array_distinct("names")).alias("archive"))
    said = lambda field: F.exists("entries", lambda e: (e["archive"] == F.col("archive")) & e[field])
    flags = one.select("archive", "dir", said("is_dir").alias("has_dirs"), "has_hidden", said("bad").alias("unreadable"))
    return flags if only is None else flags.join(only.select(*PAIR), PAIR, "left_semi")


def compare_listings(members: DataFrame, dirfiles: DataFrame, flags: DataFrame) -> DataFrame:
    """Both sides in one pass: their union, tagged, and one conditional aggregate by (archive, dir, rel),
    with the same answer as :func:`compare` on :func:`sides`. Names spread a pair over tasks."""
    pairs = flags.select(*PAIR)
    a = archive_side(members, pairs).select(*PAIR, nfc("rel").alias("rel"), F.struct("pos", "size").alias("a"))
    listed = dirfiles.join(flags.select(*PAIR, "has_dirs"), "dir").filter(
        (F.col("has_dirs") | ~F.col("rel").endswith("/")) & no_hidden_component("rel"))
    d = listed.select(*PAIR, nfc("rel").alias("rel"), F.struct(F.col("rel").alias("name"), "size").alias("d"))
    rows = a.withColumn("d", F.lit(None).cast(d.schema["d"].dataType)).unionByName(d.withColumn("a", F.lit(None).cast(a.schema["a"].dataType)))
    # the last copy of a name that an archive lists twice; one entry of names that are equal in NFC
    met = rows.groupBy(*KEY).agg(F.max("a").alias("a"), F.max("d").alias("d"))
    met = met.select(*KEY, "a", "d", F.col("a.size").alias("archive_size"), F.col("d.size").alias("dir_size"))
    kind = (F.when(F.col("a").isNull(), "extra").when(F.col("d").isNull(), "missing")
            .when(same_size(), "same").otherwise("size_mismatch"))
    return met.select(*KEY, kind.alias("kind"), "archive_size", "dir_size")


def structure_diff(members: DataFrame, dirfiles: DataFrame) -> DataFrame:
    """Every difference: ``archive, dir, rel, kind, archive_size, dir_size``."""
    return compare_listings(members, dirfiles, pair_flags(members, dirfiles)).filter(F.col("kind") != "same")


def diff_missing(a: DataFrame, d: DataFrame) -> DataFrame:
    return a.join(d, KEY, "left_anti")


def diff_extra(a: DataFrame, d: DataFrame) -> DataFrame:
    return d.join(a, KEY, "left_anti")


def diff_size(a: DataFrame, d: DataFrame) -> DataFrame:
    return a.join(d, KEY, "inner").filter(~same_size())


def identical_pairs(pairs: DataFrame, diffs: DataFrame) -> DataFrame:
    """Per pair: number of differences and ``identical`` (no differences, also for empty pairs)."""
    n = diffs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_differences"))
    return (pairs.join(n, PAIR, "left")
            .select(*PAIR, F.coalesce("n_differences", F.lit(0)).cast("bigint").alias("n_differences"))
            .withColumn("identical", F.col("n_differences") == 0))


def diff_summary(ident: DataFrame) -> DataFrame:
    """One row: total pairs, identical, different, identical percentage."""
    return (ident.agg(F.count(F.lit(1)).alias("total"), F.count_if("identical").alias("identical"))
            .select("total", "identical", (F.col("total") - F.col("identical")).alias("different"),
                    percentage("identical", "total").alias("identical_pct")))


def kind_rank(kind) -> Column:
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k == "missing", KIND_RANK["missing"]).when(k == "extra", KIND_RANK["extra"]).otherwise(KIND_RANK["size_mismatch"])


def message(kind, rel, a_size, d_size) -> Column:
    k = F.col(kind)
    return (F.when(k == "missing", F.concat(F.lit("Missing in directory: "), F.col(rel)))
            .when(k == "extra", F.concat(F.lit("Extra in directory: "), F.col(rel)))
            .otherwise(F.concat(F.lit("Size mismatch for "), F.col(rel), F.lit(": archive="),
                                F.col(a_size).cast("string"), F.lit(", directory="), F.col(d_size).cast("string"))))


def diff_messages(diffs: DataFrame) -> DataFrame:
    """The differences as report lines with their order key (missing, extra, then sizes; by name).

    Kept as rows -- never gathered into one list per pair -- and ordered by a global sort.
    """
    return (diffs.select(*PAIR, kind_rank("kind").alias("kind_rank"), "rel",
                         message("kind", "rel", "archive_size", "dir_size").alias("message"))
            .orderBy(*PAIR, "kind_rank", "rel"))


def top_differences(diffs: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` report lines per pair plus one '... and N more' line where needed.

    ``row_number() <= k`` lets Spark insert a per-partition group limit before the shuffle, so a
    pair with millions of differences ships at most ``k`` rows per task.
    """
    w = Window.partitionBy(*PAIR).orderBy("kind_rank", "rel")
    lines = (diffs.select(*PAIR, kind_rank("kind").alias("kind_rank"), "rel",
                          message("kind", "rel", "archive_size", "dir_size").alias("message"))
             .withColumn("line", F.row_number().over(w)).filter(F.col("line") <= k)
             .select(*PAIR, "line", "message"))
    more = (diffs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > k)
            .select(*PAIR, F.lit(k + 1).alias("line"),
                    F.concat(F.lit("... and "), (F.col("n") - k).cast("string"), F.lit(" more differences")).alias("message")))
    return lines.unionByName(more)
