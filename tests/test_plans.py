"""Plans: collisions, statuses, after-state, approvals, modes, clean-up order."""

import pytest
from pyspark.sql import functions as F

from lakerules.operators.match import match_rules
from lakerules.plans import actions as P
from lakerules.plans import cleanup as Cl
from lakerules.plans import decisions as Dc
from lakerules.plans.sinks import write_survivors
from lakerules.sources import inventory as I
from tests.helpers import AS_OF, inv_df


def _plan(spark, rows, rules, **kw):
    inv = inv_df(spark, rows)
    matched = match_rules(inv, rules, AS_OF)
    return P.plan_actions(matched, rules, inv.select("parent", "name"), **kw), inv


def test_move_and_compress_collisions(spark):
    rows = [("/b", "test_file.txt", 5, 10, False), ("/b/out", "test_file.txt", 1, 10, False),
            ("/b", "test_dir", 9, 10, True), ("/b/z", "test_dir.zip", 1, 10, False),
            ("/b", "fake.zip", 3, 10, True), ("/b", "keep.zip", 3, 10, False)]
    rules = [{"conditions": {"end": ".txt"}, "action": {"type": "move", "target": "out"}},
             {"conditions": {"start": "test"}, "is_directory": True, "action": {"type": "compress", "target": "z"}},
             {"conditions": {"end": ".zip"}, "is_directory": True, "action": {"type": "compress", "target": "z"}},
             {"conditions": {"end": ".zip"}, "action": {"type": "compress", "target": "z"}}]
    plan, _ = _plan(spark, rows, rules)
    got = {r.name: (r.final_path, r.status) for r in plan.filter(F.col("parent") == "/b").collect()}
    assert got["test_file.txt"] == ("/b/out/test_file_1.txt", "planned")
    assert got["test_dir"] == ("/b/z/test_dir_1.zip", "planned")
    assert got["fake.zip"] == ("/b/z/fake.zip.zip", "planned")       # a directory named .zip is packed
    assert got["keep.zip"] == (None, "skipped_archive")               # an archive file is not


def test_invalid_actions_are_processed_but_skipped(spark):
    rows = [("/b", n, 1, 1, False) for n in ("a.x", "b.x", "c.x", "d.x", "e.x")]
    rules = [{"conditions": {"start": "a"}, "action": {"type": "move"}},
             {"conditions": {"start": "b"}, "action": {"type": "invalid"}},
             {"conditions": {"start": "c"}, "action": {"type": "compress"}},
             {"conditions": {"start": "d"}, "action": {}},
             {"conditions": {"start": "e"}, "action": {"type": "move", "target": "."}}]
    plan, _ = _plan(spark, rows, rules)
    got = {r.name: (r.status, r.decision) for r in plan.collect()}
    assert got == {"a.x": ("missing_target", False), "b.x": ("invalid_action", False),
                   "c.x": ("missing_target", False), "d.x": ("invalid_action", False), "e.x": ("unchanged", True)}


def test_after_state_descendants_follow_entry(spark):
    files = inv_df(spark, [("/b/test", "f1.txt", 1, 1, False), ("/b/test/sub", "f2.txt", 2, 1, False),
                           ("/b/old", "g.txt", 3, 1, False), ("/b", "test.zip", 9, 1, False)])
    entries = I.collect_level(I.entries(files), "/b", include_hidden=True)
    rules = [{"conditions": {"start": "test"}, "is_directory": True, "action": {"type": "move", "target": "moved"}},
             {"conditions": {"start": "old"}, "is_directory": True, "action": {"type": "delete"}}]
    matched = match_rules(entries, rules, AS_OF)
    plan = P.plan_actions(matched, rules, I.entries(files).select("parent", "name"),
                          mode=Dc.AUTOMATIC, always_delete=True)
    after = {r.path for r in P.after_state(files, plan, base="/b").collect()}
    assert after == {"/b/moved/test/f1.txt", "/b/moved/test/sub/f2.txt", "/b/test.zip"}


def test_dry_run_changes_nothing(spark):
    rows = [("/b", "x.log", 1, 1, False)]
    plan, inv = _plan(spark, rows, [{"conditions": {"end": ".log"}, "action": {"type": "delete"}}], mode=Dc.DRY_RUN)
    assert [r.decision for r in plan.collect()] == [False]
    assert P.survivors(inv, plan).count() == 1


def test_sticky_answers(spark):
    prompts = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k"), (4, "j"), (5, "j"), (6, "j")], "id long, key string")
    answers = spark.createDataFrame([(1, "a"), (2, "n"), (3, "n"), (4, "y"), (5, "NEVER "), (6, "y")], "id long, resp string")
    got = {r.id: (r.approved, r.sticky) for r in Dc.approvals(prompts, answers).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (True, True),
                   4: (True, False), 5: (False, False), 6: (False, True)}


@pytest.mark.parametrize("flags,mode", [((True, False, False), "dry_run"), ((False, True, False), "automatic"),
                                         ((False, False, True), "automatic"), ((False, False, False), "interactive"),
                                         ((True, True, False), "dry_run")])
def test_organize_mode(flags, mode):
    assert Dc.organize_mode(*flags) == mode


def test_conflicting_flags_rejected():
    with pytest.raises(ValueError):
        Dc.organize_mode(False, True, True)
    with pytest.raises(ValueError):
        Dc.cleanup_mode(True, True)
    assert Dc.cleanup_mode(never_delete=True) == "dry_run"


def test_never_delete_means_never(spark):
    rows = [("/b", "x.log", 1, 1, False), ("/b", "y.txt", 1, 1, False)]
    rules = [{"conditions": {"end": ".log"}, "action": {"type": "delete"}},
             {"conditions": {"end": ".txt"}, "action": {"type": "move", "target": "t"}}]
    plan, _ = _plan(spark, rows, rules, mode=Dc.organize_mode(never_delete=True), always_delete=False)
    assert {r.name: r.decision for r in plan.collect()} == {"x.log": False, "y.txt": True}


def test_cleanup_order_first_identical_removes(spark):
    c = spark.createDataFrame([("/p/x.7z", "/p/x", 0, True, False), ("/p/x.zip", "/p/x", 0, True, False),
                               ("/p/y.zip", "/p/y", 2, False, False), ("/p/x/in.zip", "/p/x/in", 0, True, False)],
                              "archive string, dir string, n_differences long, identical boolean, has_hidden boolean")
    got = {r.archive: r.status for r in Cl.cleanup_plan(c, Dc.AUTOMATIC, always_delete=True).collect()}
    assert got == {"/p/x.7z": "removed", "/p/x.zip": "gone", "/p/y.zip": "different", "/p/x/in.zip": "gone"}


def test_run_stats(spark):
    rows = [("/b", f"f{i}.txt", 1, 1, False) for i in range(8)] + [("/b", "a.bin", 1, 1, False), ("/b", "b.bin", None, 1, False)]
    m = match_rules(inv_df(spark, rows), [{"conditions": {"end": ".txt"}, "action": {"type": "delete"}}], AS_OF)
    r = P.run_stats(m).collect()[0]
    assert (r.total_files, r.processed_files, r.skipped_files, r.errors) == (10, 8, 1, 1)


def test_builtin_action_cannot_be_replaced():
    with pytest.raises(ValueError):
        P.register_actions({"move": lambda p, n: p})


def test_action_registry_helpers():
    custom = P.register_actions({"tag": lambda p, n: p})
    assert P.available_actions(custom) == ["move", "delete", "compress", "tag"]
    assert P.is_action_supported("tag", custom) and not P.is_action_supported("shred", custom)


def test_sinks_write_only_what_the_plan_says(spark, tmp_path):
    from lakerules.plans import sinks as S
    rows = [("/b", "x.log", 1, 1, False), ("/b", "y.txt", 2, 1, False), ("/b", "z.bin", 3, 1, False)]
    rules = [{"name": "logs", "conditions": {"end": ".log"}, "action": {"type": "delete"}},
             {"name": "texts", "conditions": {"end": ".txt"}, "action": {"type": "move", "target": "t"}}]
    plan, inv = _plan(spark, rows, rules, mode=Dc.AUTOMATIC, always_delete=True)
    kept = S.write_survivors(inv, plan, str(tmp_path / "kept"), execute=True)
    assert {r.name for r in kept.collect()} == {"y.txt", "z.bin"}
    assert {r.name for r in spark.read.parquet(str(tmp_path / "kept")).collect()} == {"y.txt", "z.bin"}
    S.write_routed(P.route(match_rules(inv, rules, AS_OF), rules), str(tmp_path / "routed"))
    routed = {(r.name, r.route) for r in spark.read.parquet(str(tmp_path / "routed")).collect()}
    assert routed == {("x.log", "logs"), ("y.txt", "texts"), ("z.bin", "_unmatched")}
    S.write_plan(plan, str(tmp_path / "plan"))
    assert spark.read.parquet(str(tmp_path / "plan")).count() == 2
    after = {r.path for r in P.after_state(inv, plan).collect()}
    assert after == {"/b/t/y.txt", "/b/z.bin"}


def test_end_to_end_on_real_files(spark, tmp_path):
    """An archive next to its unpacked copy: the rule moves the archive with clean-up on, the
    identical directory is planned for removal; in a dry run nothing is executed."""
    import zipfile

    from lakerules.sources.archives import read_archives
    from lakerules.sources.inventory import relative_to, scan_files
    base = str(tmp_path)
    (tmp_path / "test").mkdir()
    (tmp_path / "test" / "a.txt").write_text("alpha")
    (tmp_path / "test" / "b.txt").write_text("beta!!")
    with zipfile.ZipFile(tmp_path / "test.zip", "w") as z:
        z.writestr("a.txt", "alpha")
        z.writestr("b.txt", "beta!!")
    files = scan_files(spark, base)
    level = I.collect_level(I.entries(files), base)
    assert {(r.name, r.is_directory) for r in level.collect()} == {("test.zip", False), ("test", True)}
    rules = [{"name": "archives", "conditions": {"end": ".zip"}, "action": {"type": "move", "target": "archives"},
              "delete_unpacked_on_match": True}]
    members = read_archives(spark, f"{base}/*.zip")
    from pyspark.sql import functions as F
    dirfiles = (files.withColumn("p", F.concat("parent", F.lit("/"), "name"))
                .select(F.lit(f"{base}/test").alias("dir"), relative_to("p", f"{base}/test").alias("rel"), "size")
                .filter(F.col("rel").isNotNull()))
    for mode, removed in ((Dc.AUTOMATIC, True), (Dc.DRY_RUN, False)):
        matched = match_rules(level, rules, AS_OF)
        plan = P.plan_actions(matched, rules, I.entry_names(files), mode=mode, always_delete=True)
        out = Cl.cleanup_unpacked(plan, rules, members, dirfiles, mode, always_delete=True).collect()
        if removed:
            assert [(r.final_path, r.dir, r.identical, r.decision) for r in out] == [
                (f"{base}/archives/test.zip", f"{base}/test", True, True)]
        else:
            assert out == []  # the move itself is not executed, so no clean-up follows


def test_targets_are_resolved_before_names_are_looked_up(spark):
    rows = [("/b", "k.log", 5, 10, False), ("/b/out", "k.log", 1, 10, False), ("/top", "m.csv", 1, 1, False),
            ("/", "r.log", 2, 10, False), ("/out", "r.log", 2, 10, False), ("/b/q", "u.bak", 2, 10, False)]
    rules = [{"conditions": {"start": "k"}, "action": {"type": "move", "target": "a/../out"}},
             {"conditions": {"start": "r"}, "action": {"type": "move", "target": "./out/"}},
             {"conditions": {"start": "m"}, "action": {"type": "move", "target": "../../up"}},
             {"conditions": {"start": "u"}, "action": {"type": "move", "target": "../q/."}}]
    plan, _ = _plan(spark, rows, rules)
    got = {(r.parent, r.name): (r.final_path, r.status) for r in plan.collect()}
    assert got[("/b", "k.log")] == ("/b/out/k_1.log", "planned")
    assert got[("/", "r.log")] == ("/out/r_1.log", "planned")
    assert got[("/top", "m.csv")] == ("/up/m.csv", "planned")
    assert got[("/b/q", "u.bak")] == ("/b/q/u.bak", "unchanged")


def test_after_state_moves_directory_rows_and_keeps_rows_outside(spark):
    inv = inv_df(spark, [("/b", "gone", 0, 1, True), ("/b/gone", "x", 1, 1, False), ("/b", "trip", 0, 1, True),
                         ("/b/trip", "day", 0, 1, True), ("/b/trip/day", "y", 2, 1, False),
                         ("/elsewhere", "gone", 3, 1, False)])
    rules = [{"conditions": {"start": "gone"}, "is_directory": True, "action": {"type": "delete"}},
             {"conditions": {"start": "trip"}, "is_directory": True, "action": {"type": "move", "target": "to"}}]
    matched = match_rules(inv.filter("parent = '/b'"), rules, AS_OF)
    plan = P.plan_actions(matched, rules, inv.select("parent", "name"), mode=Dc.AUTOMATIC, always_delete=True)
    after = sorted(r.path for r in P.after_state(inv, plan, base="/b").collect())
    assert after == ["/b/to/trip", "/b/to/trip/day", "/b/to/trip/day/y", "/elsewhere/gone"]


def test_entries_that_share_a_seq_stay_apart(spark):
    inv = inv_df(spark, [("/b", "one.tmp", 1, 1, False), ("/b", "two.txt", 1, 1, False)]).withColumn("seq", F.lit(7).cast("long"))
    rules = [{"conditions": {"end": ".tmp"}, "action": {"type": "delete"}}]
    plan = P.plan_actions(match_rules(inv, rules, AS_OF), rules, inv.select("parent", "name"),
                          mode=Dc.AUTOMATIC, always_delete=True)
    assert [r.name for r in P.survivors(inv, plan).collect()] == ["two.txt"]
    assert [r.path for r in P.after_state(inv, plan).collect()] == ["/b/two.txt"]


def _equal_seq_plan(spark, **options):
    inv = spark.createDataFrame([("/b", "gone.log", 1, None, False, 5), ("/b", "keep.dat", 2, None, False, 5),
                                 ("/b", "m.txt", 3, None, False, 5), ("/c", "m.txt", 4, None, False, 5), ("/b", "p.bin", 5, None, False, 5)],
                                "parent string, name string, size bigint, mtime timestamp, is_directory boolean, seq bigint")
    rules = [{"conditions": {"end": ".log"}, "action": {"type": "delete"}},
             {"conditions": {"end": ".txt"}, "action": {"type": "move", "target": "/t"}},
             {"conditions": {"end": ".bin"}, "action": {"type": "compress", "target": "/z"}}]
    matched = match_rules(inv, rules, AS_OF)
    return inv, P.plan_actions(matched, rules, inv.select("parent", "name"), always_delete=True, **options)


def test_entries_of_one_seq_stay_apart(spark):
    inv, plan = _equal_seq_plan(spark)
    rows = {r["path"]: r["final_path"] for r in plan.collect()}
    assert len(rows) == plan.count() == 4
    assert {rows["/b/m.txt"], rows["/c/m.txt"]} == {"/t/m.txt", "/t/m_1.txt"}
    left = {r["name"] for r in write_survivors(inv, plan, "unused").collect()}
    assert left == {"keep.dat", "m.txt", "p.bin"}
    assert [tuple(r) for r in P.pack_layout(inv, plan).collect()] == [("/z/p.zip", "p.bin", 5)]


def test_a_name_freed_in_the_run_is_given_out_later(spark):
    inv = spark.createDataFrame([("/t", "a.txt", 1, None, False, 1), ("/s", "a.txt", 2, None, False, 2), ("/r", "a.txt", 3, None, False, 0)],
                                "parent string, name string, size bigint, mtime timestamp, is_directory boolean, seq bigint")
    rules = [{"conditions": {"smaller": "2"}, "action": {"type": "move", "target": "/u"}},
             {"conditions": {}, "action": {"type": "move", "target": "/t"}}]
    matched = match_rules(inv, rules, AS_OF)
    for reuse, second in ((True, "/t/a.txt"), (False, "/t/a_2.txt")):
        plan = P.plan_actions(matched, rules, inv.select("parent", "name"), reuse_released=reuse)
        assert {r["path"]: r["final_path"] for r in plan.collect()} == {"/t/a.txt": "/u/a.txt", "/s/a.txt": second, "/r/a.txt": "/t/a_1.txt"}
