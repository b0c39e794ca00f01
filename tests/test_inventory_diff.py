"""Directory rollup, listings and the archive/directory comparison."""

import unicodedata
from datetime import datetime

from pyspark.sql import functions as F

from lakerules.operators import diff as D
from lakerules.sources import inventory as I


def test_rollup_size_and_newest_time(spark):
    files = spark.createDataFrame([("/t/dir", "file1.txt", 7, datetime(2024, 1, 1)),
                                   ("/t/dir/subdir", "file2.txt", 14, datetime(2024, 1, 5)),
                                   ("/t/dir/.hidden", ".x", 1, datetime(2023, 1, 1))],
                                  "parent string, name string, size bigint, mtime timestamp")
    empty = spark.createDataFrame([("/t/dir/empty",)], "path string")
    got = {r.path: (r.size, r.mtime) for r in I.dir_rollup(files, empty).collect()}
    assert got["/t/dir"] == (22, datetime(2024, 1, 5))  # hidden files count in the size
    assert got["/t/dir/subdir"] == (14, datetime(2024, 1, 5))
    assert got["/t/dir/empty"] == (0, datetime(1970, 1, 1))


def test_depth_listing_skips_hidden_subtrees(spark):
    files = spark.createDataFrame([("/b", "a.txt", 1), ("/b/sub", "c.txt", 1), ("/b/.h", "d.txt", 1),
                                   ("/b/sub/deep", "e.txt", 1)], "parent string, name string, size bigint") \
        .withColumn("mtime", F.lit(None).cast("timestamp"))
    e = I.entries(files)
    got = {r.rel for r in I.collect_depth(e, "/b", 2).collect()}
    assert got == {"a.txt", "sub", "sub/c.txt", "sub/deep"}
    assert I.collect_depth(e, "/b", 0).count() == 0
    assert {r.name for r in I.collect_level(e, "/b").collect()} == {"a.txt", "sub"}


MEMBERS = "archive string, member string, size bigint, pos bigint"
DIRFILES = "dir string, rel string, size bigint"


def _compare(spark, members, dirfiles):
    m = spark.createDataFrame(members, MEMBERS)
    d = spark.createDataFrame(dirfiles, DIRFILES)
    pairs, a, dd = D.sides(m, d)
    ident = D.identical_pairs(pairs, D.compare(a, dd).filter(F.col("kind") != "same"))
    diffs = {(r.rel, r.kind) for r in D.compare(a, dd).filter(F.col("kind") != "same").collect()}
    return {r.archive: r.identical for r in ident.collect()}, diffs


STRUCT = [("file1.txt", 7), ("subdir1/", 0), ("subdir1/file2.txt", 14), ("subdir2/", 0), ("subdir2/file3.txt", 21)]


def test_structure_with_subdirectories(spark):
    members = [("/x/test.zip", n, s, i) for i, (n, s) in enumerate(STRUCT)]
    dirfiles = [("/x/test", n, s) for n, s in STRUCT]
    ident, diffs = _compare(spark, members, dirfiles)
    assert ident == {"/x/test.zip": True} and diffs == set()


def test_zip_without_directory_entries_is_identical(spark):
    members = [("/x/test.zip", n, s, i) for i, (n, s) in enumerate(STRUCT) if not n.endswith("/")]
    dirfiles = [("/x/test", n, s) for n, s in STRUCT]
    ident, _ = _compare(spark, members, dirfiles)
    assert ident == {"/x/test.zip": True}


def test_missing_extra_and_size(spark):
    members = [("/x/a.zip", "a/one.txt", 1, 0), ("/x/a.zip", "a/", 0, 1), ("/x/a.zip", "a/two.txt", 2, 2)]
    dirfiles = [("/x/a", "one.txt", 1), ("/x/a", "two.txt", 3), ("/x/a", "three.txt", 3), ("/x/a", ".hidden", 9)]
    ident, diffs = _compare(spark, members, dirfiles)
    assert ident == {"/x/a.zip": False}
    assert diffs == {("two.txt", "size_mismatch"), ("three.txt", "extra")}


def test_unicode_root_and_names(spark):
    nfd = unicodedata.normalize("NFD", "café")
    nfc = unicodedata.normalize("NFC", "café")
    members = [(f"/u/{nfc}.zip", f"{nfd}/", 0, 0), (f"/u/{nfc}.zip", f"{nfd}/{nfd}.txt", 5, 1)]
    dirfiles = [(f"/u/{nfc}", f"{nfc}.txt", 5)]
    ident, diffs = _compare(spark, members, dirfiles)
    assert ident == {f"/u/{nfc}.zip": True} and diffs == set()


def test_duplicate_member_last_copy_wins(spark):
    members = [("/x/a.zip", "f.txt", 1, 0), ("/x/a.zip", "f.txt", 5, 1)]
    ident, _ = _compare(spark, members, [("/x/a", "f.txt", 5)])
    assert ident == {"/x/a.zip": True}


def test_top_differences_caps_lines(spark):
    members = [("/x/a.zip", f"m{i:02d}.txt", 1, i) for i in range(8)]
    m = spark.createDataFrame(members, MEMBERS)
    d = spark.createDataFrame([("/x/a", "other.txt", 1)], DIRFILES)
    lines = sorted((r.line, r.message) for r in D.top_differences(D.structure_diff(m, d), 5).collect())
    assert len(lines) == 6 and lines[0][1] == "Missing in directory: m00.txt"
    assert lines[-1][1] == "... and 4 more differences"


def test_unknown_size_never_counts_as_equal(spark):
    for left, right in ((None, 5), (5, None), (None, None)):
        ident, diffs = _compare(spark, [("/q/box.zip", "kept.bin", left, 0)], [("/q/box", "kept.bin", right)])
        assert ident == {"/q/box.zip": False} and diffs == {("kept.bin", "size_mismatch")}


def test_one_pass_equals_the_join_of_the_sides(spark):
    """Random listings: names in two normal forms, double members, hidden entries, roots, empty sides,
    several archives per directory, unknown sizes."""
    import random

    from pyspark.sql import functions as F

    from lakerules.operators import diff as D
    rng = random.Random(9)
    names = ["a.txt", "s/b.txt", "s/", "caf\u00e9.txt", "cafe\u0301.txt", ".h/x", "s/.y", "z"]
    members, listing = [], []
    for k in range(40):
        stem = f"/r/{rng.choice(['p', 'q'])}{k}"
        for ext in rng.sample([".zip", ".7z", ".ZIP", ".txt"], rng.randint(0, 3)):
            for pos in range(rng.randint(0, 7)):
                n = rng.choice([*names, ""])
                members.append((stem + ext, rng.choice(["", stem.rsplit("/", 1)[1] + "/"]) + n or "x", rng.choice([1, 1, 2, None]), pos))
        listing += [(stem, n, rng.choice([1, 1, 2, None])) for n in rng.sample(names, rng.randint(0, 6)) if rng.random() < .8]
    m = spark.createDataFrame(members, "archive string, member string, size long, pos long")
    f = spark.createDataFrame(listing, "dir string, rel string, size long")
    pairs, a, d = D.sides(m, f)
    flags = D.pair_flags(m, f)
    plain = lambda df, *cols: sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    assert plain(flags, "archive", "dir", "has_dirs") == plain(
        pairs.join(D.has_dirs(m, pairs), D.PAIR, "left"), "archive", "dir", F.coalesce("has_dirs", F.lit(False)))
    cols = [*D.KEY, "kind", "archive_size", "dir_size"]
    assert plain(D.compare_listings(m, f, flags), *cols) == plain(D.compare(a, d), *cols)


def test_given_pairs_of_archives_without_members_are_compared(spark):
    from lakerules.plans.cleanup import compared_pairs
    m = spark.createDataFrame([("/r/b.zip", "x", 1, 0)], "archive string, member string, size long, pos long")
    f = spark.createDataFrame([("/r/a", "y", 1), ("/r/a", ".h", 1), ("/r/b", "x", 1)], "dir string, rel string, size long")
    pairs = spark.createDataFrame([("/r/a.zip", "/r/a")], "archive string, dir string")
    assert [tuple(r) for r in compared_pairs(m, f, pairs).collect()] == [("/r/a.zip", "/r/a", 1, False, True)]
