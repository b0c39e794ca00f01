"""Inventory operators.

An inventory is a table of files, one row each (``parent, name, size, mtime``); directories are
implicit in the paths. Directory rows are *derived*: their size is the sum of every descendant
file and their time the newest descendant time. The rollup first aggregates by the immediate
parent (a partial aggregate map-side, so a directory holding a third of all files costs one row
per task), then fans each parent out to its ancestors -- only distinct parents are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import _c, is_archive, name_of, parent_of, path_of, stem_of
from ..functions.conditions import no_hidden_component, not_hidden


def scan_files(spark, pattern: str, recursive: bool = True) -> DataFrame:
    """Inventory rows of real files via the ``binaryFile`` source (S1); the content column is
    never selected, so it is pruned and only metadata is read.

    Note: file sources skip names starting with '.' or '_' and do not list empty directories;
    an inventory table is needed when those matter.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
             .load(pattern).select("path", "length", "modificationTime"))
    p = F.regexp_replace("path", r"^file:", "")
    return files.select(parent_of(p).alias("parent"), name_of(p).alias("name"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("mtime"), F.lit(False).alias("is_directory"),
                        F.xxhash64(p).alias("seq"))


def self_and_ancestors(dir_col) -> Column:
    """['/a', '/a/b'] for '/a/b'; ['x', 'x/y'] for 'x/y'; [] for '' (the root is not a row)."""
    parts = F.split(_c(dir_col), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.filter(prefixes, lambda x: x != F.lit(""))


def relative_to(path, base: str) -> Column:
    """Path below ``base`` (NULL when not below it)."""
    prefix = base.rstrip("/") + "/"
    p = _c(path)
    return F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 30))


def dir_rollup(files: DataFrame, known_dirs: DataFrame | None = None) -> DataFrame:
    """One row per directory: ``path, size`` (sum of descendant files), ``mtime`` (newest),
    ``n_files``. Directories in ``known_dirs`` without files get size 0 and time 0 (epoch)."""
    per_parent = (files.groupBy("parent")
                  .agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"), F.count(F.lit(1)).alias("n_files")))
    fanned = per_parent.select(F.explode(self_and_ancestors("parent")).alias("path"), "size", "mtime", "n_files")
    rolled = (fanned.groupBy("path")
              .agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"), F.sum("n_files").alias("n_files")))
    if known_dirs is None:
        return rolled
    known = known_dirs.select(F.explode(self_and_ancestors("path")).alias("path")).distinct()
    empty = known.join(rolled.select("path"), "path", "left_anti")
    return rolled.unionByName(empty.select(
        "path", F.lit(0).cast("bigint").alias("size"), F.timestamp_seconds(F.lit(0)).alias("mtime"),
        F.lit(0).cast("bigint").alias("n_files")))


def entries(files: DataFrame, known_dirs: DataFrame | None = None) -> DataFrame:
    """Files plus derived directory rows, in the inventory schema
    ``parent, name, size, mtime, is_directory`` (directories carry the rollup)."""
    dirs = dir_rollup(files, known_dirs)
    dir_rows = dirs.select(parent_of("path").alias("parent"), name_of("path").alias("name"), "size", "mtime",
                           F.lit(True).alias("is_directory"))
    file_rows = files.select("parent", "name", "size", "mtime", F.lit(False).alias("is_directory"))
    return file_rows.unionByName(dir_rows)


def entry_names(files: DataFrame) -> DataFrame:
    """``parent, name`` of every file and every directory implied by the paths (no sizes): the
    names a plan must not collide with. Distinct parents are fanned out, not every file."""
    dirs = (files.select("parent").distinct()
            .select(F.explode(self_and_ancestors("parent")).alias("path")).distinct()
            .select(parent_of("path").alias("parent"), name_of("path").alias("name")))
    return files.select("parent", "name").unionByName(dirs)


def collect_level(inv: DataFrame, base: str, include_hidden: bool = False) -> DataFrame:
    """Direct children of ``base`` (files and directories); hidden ones skipped by default."""
    b = base.rstrip("/")
    out = inv.filter(F.col("parent") == F.lit(b))
    return out if include_hidden else out.filter(not_hidden("name"))


def collect_depth(inv: DataFrame, base: str, max_depth: int = 1, include_hidden: bool = False) -> DataFrame:
    """Entries at most ``max_depth`` levels below ``base``; hidden directories are not descended."""
    if max_depth < 1:
        return inv.filter(F.lit(False))  # depth below 1 lists nothing
    rel = relative_to(path_of("parent", "name"), base)
    out = inv.withColumn("rel", rel).filter(F.col("rel").isNotNull() & (F.size(F.split("rel", "/")) <= max_depth))
    if not include_hidden:
        out = out.filter(no_hidden_component("rel"))
    return out


def paths_to_files(paths: DataFrame, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """Split a path listing into (files, explicit directory entries); a trailing '/' marks a dir."""
    p = F.col(path_col)
    is_dir = p.endswith("/")
    files = paths.filter(~is_dir).select(parent_of(p).alias("parent"), name_of(p).alias("name"), "*")
    dirs = paths.filter(is_dir).select(F.regexp_replace(p, "/+$", "").alias("path")).filter(F.col("path") != "")
    return files.drop(path_col), dirs


def dir_structure(paths: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Listing of every top-level directory as relative names, as an archive lists its members:
    files with their size, and one ``sub/`` entry (size 0) per directory below the top.

    ``paths``: ``path, size`` with absolute paths; a trailing '/' is a directory entry.
    Output: ``dir, rel, size, is_dir_entry``.
    """
    p = F.col("path")
    top = F.regexp_extract(p, r"^/([^/]+)/", 1)
    rel = F.regexp_extract(p, r"^/[^/]+/(.*)$", 1)
    base = paths.select(F.concat(F.lit("/"), top).alias("dir"), rel.alias("rel"), "size").filter(F.col("rel") != "")
    files = (base.filter(~F.col("rel").endswith("/"))
             .select("dir", "rel", "size", F.lit(False).alias("is_dir_entry")))
    # every directory on the way down (plus explicit entries), each once per top directory
    comps = F.split(F.regexp_replace("rel", "/+$", ""), "/")
    n_dirs = F.when(F.col("rel").endswith("/"), F.size(comps)).otherwise(F.size(comps) - 1)
    dirs = (base.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n_dirs, F.lit(1))),
                                                      lambda i: F.concat(F.array_join(F.slice(comps, F.lit(1), i), "/"), F.lit("/")))
                                          ).alias("rel"), n_dirs.alias("n"))
            .filter(F.col("n") >= 1).select("dir", "rel").distinct()
            .select("dir", "rel", F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("is_dir_entry")))
    out = files.unionByName(dirs)
    return out if include_hidden else out.filter(no_hidden_component("rel"))


def dir_details(listing: DataFrame) -> DataFrame:
    """Details table keyed by (dir, rel): ``size`` and the full ``path``.

    The per-directory dict of the original is kept as rows keyed by (dir, rel) instead of a map
    column, so a directory with millions of entries is never gathered into a single value.
    """
    return (listing.groupBy("dir", "rel")
            .agg(F.max("size").alias("size"))
            .withColumn("path", F.concat(F.col("dir"), F.lit("/"), F.regexp_replace("rel", "/$", ""))))


def _dirs_of(inventory: DataFrame) -> DataFrame:
    """``path`` of every directory that holds rows, and of explicit directory rows; not their ancestors."""
    held = inventory.select(F.col("parent").alias("path"))
    if "is_directory" in inventory.columns:
        held = held.unionByName(inventory.filter("is_directory").select(path_of("parent", "name").alias("path")))
    return held.filter("path <> ''").distinct()


def archives_with_directory(inventory: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """``archive, dir``: archive files at any depth with a directory of their stem beside them.

    The directories need no rows of their own: a path below one implies it. ``archives`` (column
    ``archive``) restricts or replaces the inventory's own. Ancestors are listed for distinct
    directories only, and meet the few names wanted by archives in an equi-join. Hidden entries count.
    An inventory without archives gives no rows.
    """
    if archives is None:
        is_file = ~F.coalesce(F.col("is_directory"), F.lit(False)) if "is_directory" in inventory.columns else F.lit(True)
        at = inventory.filter(is_file & is_archive("name")).select("parent", "name").distinct()
    else:
        at = archives.select("archive").distinct().select(parent_of("archive").alias("parent"), name_of("archive").alias("name"))
        at = at.filter(is_archive("name"))
    wanted = at.select(path_of("parent", "name").alias("archive"), path_of("parent", stem_of("name")).alias("dir"))
    there = _dirs_of(inventory).select(F.explode(self_and_ancestors("path")).alias("dir")).distinct()
    return wanted.join(there, "dir").select("archive", "dir")


def list_directories(inventory: DataFrame, dirs: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Listing of each directory in ``dirs`` (column ``dir``), at any depth: ``dir, rel, size, mtime,
    is_dir_entry`` (S4, S6). Names are relative to ``dir``; those of directories end in ``/``.

    - Files keep size and time. A directory has size 0 and the time of its own row; without one, or
      with a null time there, that of the newest row right in it, which may be null.
    - Directories are those with rows below them and those with a row of their own, each once. A
      directory listed inside another one of ``dirs`` appears in both listings.
    - Nulls in ``dir`` or ``parent`` list nothing; repeated file rows stay repeated; a directory
      without rows has no listing. Hidden entries are left out unless ``include_hidden``.

    Only distinct directories are exploded to their ancestors, and only those below a wanted one go on
    to meet the files by their immediate parent; AQE splits a parent that holds many of them.
    """
    inv = inventory if "is_directory" in inventory.columns else inventory.withColumn("is_directory", F.lit(False))
    inv = inv if "mtime" in inv.columns else inv.withColumn("mtime", F.lit(None).cast("timestamp"))
    inv = inv.select("parent", "name", "size", "mtime", F.coalesce("is_directory", F.lit(False)).alias("is_directory"))
    wanted = dirs.select("dir").filter("dir <> ''").distinct()
    below = (_dirs_of(inv).select(F.col("path").alias("parent"), F.explode(self_and_ancestors("path")).alias("dir"))
             .join(wanted, "dir"))
    below = below.select("dir", "parent", F.expr("substring(parent, length(dir) + 2)").alias("_at"))
    rel = F.when(F.col("_at") == "", F.col("name")).otherwise(F.concat("_at", F.lit("/"), "name"))
    files = (inv.filter(~F.col("is_directory")).join(below, "parent")
             .select("dir", rel.alias("rel"), "size", "mtime", F.lit(False).alias("is_dir_entry")))
    # one row per directory of the inventory, with its own time or the newest right in it
    own = inv.filter("is_directory").select(path_of("parent", "name").alias("parent"), F.col("mtime").alias("own"),
                                            F.lit(None).cast("timestamp").alias("newest"))
    held = inv.filter(~F.col("is_directory")).select("parent", F.lit(None).cast("timestamp").alias("own"), F.col("mtime").alias("newest"))
    times = (own.unionByName(held).groupBy("parent")
             .agg(F.coalesce(F.max("own"), F.max("newest")).alias("mtime")))
    timed = below.join(times, "parent", "left")
    entries_ = (timed.select("dir", F.explode(self_and_ancestors("_at")).alias("rel"), "_at", "mtime")
                .groupBy("dir", "rel").agg(F.max(F.when(F.col("rel") == F.col("_at"), F.col("mtime"))).alias("mtime"))
                .select("dir", F.concat("rel", F.lit("/")).alias("rel"), F.lit(0).cast("bigint").alias("size"), "mtime",
                        F.lit(True).alias("is_dir_entry")))
    out = files.unionByName(entries_)
    return out if include_hidden else out.filter(no_hidden_component("rel"))


def listing_details(listing: DataFrame) -> DataFrame:
    """Details keyed by (dir, rel): ``size, date`` (whole seconds of the epoch) and the full ``path``
    (S6). Rows repeated under one key give the newest one's size and date, nulls last."""
    newest = F.max(F.struct("mtime", "size"))
    return (listing.groupBy("dir", "rel").agg(newest.alias("_n"))
            .select("dir", "rel", F.col("_n.size").alias("size"), F.unix_seconds("_n.mtime").alias("date"),
                    F.concat(F.col("dir"), F.lit("/"), F.regexp_replace("rel", "/$", "")).alias("path")))
