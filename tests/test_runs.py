"""Whole runs, listings at any depth and the stream's epochs, against small worlds checked by hand or by a plain model."""

import os
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.types import _parse_datatype_string

from lakerules.plans import runs as R
from lakerules.sources import inventory as I
from lakerules.streaming import match_stream as S

INV = "parent string, name string, size bigint, mtime timestamp, is_directory boolean"
T = [datetime(2024, 1, d) for d in range(1, 10)]


def world(spark, rows):
    return spark.createDataFrame([(p, n, s, t, d) for p, n, s, t, d in rows], INV)


FILES = [
    ("/w", "a.zip", 5, T[0], False), ("/w/a", "x.txt", 3, T[1], False), ("/w/a/sub/deep", "y.txt", 2, T[2], False),
    ("/w/a", "empty", None, T[3], True), ("/w/a/.git", "h", 1, T[4], False), ("/w/lonely", "z", 1, None, False),
    ("/w/q/r", "b.7Z", 1, T[0], False), ("/w/q/r/b", "b.rar", 1, T[0], False), ("/w/q/r/b", "b", None, T[5], True),
    (None, "gone.zip", 1, T[0], False), ("", "top.zip", 1, T[0], False), ("/top", "f", 1, T[0], False),
]


def test_archives_find_their_directory_at_any_depth(spark):
    pairs = {tuple(r) for r in I.archives_with_directory(world(spark, FILES)).collect()}
    assert pairs == {("/w/a.zip", "/w/a"), ("/w/q/r/b.7Z", "/w/q/r/b"), ("/w/q/r/b/b.rar", "/w/q/r/b/b"), ("/top.zip", "/top")}
    assert I.archives_with_directory(world(spark, [])).count() == 0


def test_listing_names_sizes_and_times(spark):
    dirs = spark.createDataFrame([("/w/a",), ("/w/q/r/b",), ("/w/none",), (None,)], "dir string")
    rows = {(r.dir, r.rel): (r.size, r.mtime, r.is_dir_entry)
            for r in I.list_directories(world(spark, FILES), dirs, include_hidden=True).collect()}
    assert rows == {
        ("/w/a", "x.txt"): (3, T[1], False), ("/w/a", "sub/"): (0, None, True), ("/w/a", "sub/deep/"): (0, T[2], True),
        ("/w/a", "sub/deep/y.txt"): (2, T[2], False), ("/w/a", "empty/"): (0, T[3], True),
        ("/w/a", ".git/"): (0, T[4], True), ("/w/a", ".git/h"): (1, T[4], False),
        ("/w/q/r/b", "b.rar"): (1, T[0], False), ("/w/q/r/b", "b/"): (0, T[5], True)}
    shown = {r.rel for r in I.list_directories(world(spark, FILES), dirs).filter("dir = '/w/a'").collect()}
    assert shown == {"x.txt", "sub/", "sub/deep/", "sub/deep/y.txt", "empty/"}
    details = {r.rel: (r.size, r.path) for r in I.listing_details(I.list_directories(world(spark, FILES), dirs)).collect()
               if r.dir == "/w/a"}
    assert details["empty/"] == (0, "/w/a/empty") and details["x.txt"] == (3, "/w/a/x.txt")


PATHS = st.lists(st.sampled_from(["a", "b", "a/b", "a/b/c", "b/a", "a/a/a/a"]), min_size=1, max_size=6)


@settings(max_examples=6, deadline=None)
@given(PATHS, st.lists(st.sampled_from(["/a", "/a/b", "/b", "/a/a"]), min_size=1, max_size=3))
def test_listing_equals_a_walk(spark, parents, wanted):
    rows = [("/" + p, f"f{i}", i, None, False) for i, p in enumerate(parents)]
    got = sorted((r.dir, r.rel) for r in I.list_directories(world(spark, rows), spark.createDataFrame([(w,) for w in wanted], "dir string")).collect())
    expect = []
    for w in set(wanted):
        below = [f"{p}/{n}"[len(w) + 1:] for p, n, *_ in rows if f"{p}/".startswith(w + "/")]
        folders = {"/".join(x.split("/")[:k]) + "/" for x in below for k in range(1, x.count("/") + 1)}
        expect += [(w, x) for x in below] + [(w, x) for x in folders]
    assert got == sorted(expect)


def _ask(pairs, answers):
    """The prompts one after the other: what a person at the terminal would see happen."""
    sticky, gone, approved = {}, set(), set()
    for archive, d, same in sorted(pairs):
        if not same or d in gone:
            continue
        key = d.rsplit("/", 1)[0]
        said = sticky.get(key) or {"": "y"}.get(answers.get(archive, "none").strip().lower(), answers.get(archive, "none").strip().lower())
        if said in ("a", "never"):
            sticky[key] = said
        if said in ("y", "a"):
            approved.add(archive)
            gone.add(d)
    return gone


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 1), st.integers(0, 3), st.sampled_from(["7z", "rar", "zip"])),
                       st.tuples(st.booleans(), st.sampled_from(["", "y", "N", " a ", "never", "what", "n"])), min_size=1, max_size=12))
def test_answers_equal_prompts_one_after_the_other(spark, cases):
    inv, members, answers, pairs = [], [], {}, []
    for (g, k, ext), (same, resp) in cases.items():
        archive, d = f"/g{g}/d{k}.{ext}", f"/g{g}/d{k}"
        inv += [(f"/g{g}", f"d{k}.{ext}", 1, T[0], False), (d, "f", 4, T[0], False)]
        members.append((archive, "f", 4 if same else 5))
        answers[archive] = resp
        pairs.append((archive, d, same))
    inv = world(spark, list(dict.fromkeys(inv)))
    plan = R.delete_unpacked(inv, spark.createDataFrame(members, "archive string, member string, size bigint"),
                             spark.createDataFrame(list(answers.items()), "id string, resp string"))
    assert {r.dir for r in plan.collect() if r.removes} == _ask(pairs, answers)


def test_cleanup_modes(spark):
    inv = world(spark, [("/g", "d.zip", 1, T[0], False), ("/g/d", "f", 4, T[0], False)])
    members = spark.createDataFrame([("/g/d.zip", "f", 4)], "archive string, member string, size bigint")
    status = lambda **flags: R.delete_unpacked(inv, members, **flags).first().status
    assert (status(always_delete=True), status(never_delete=True), status()) == ("removed", "kept", "kept")
    assert R.delete_unpacked(world(spark, []), members, always_delete=True).count() == 0
    with pytest.raises(ValueError):
        status(always_delete=True, never_delete=True)


RULES = [
    {"name": "bundles", "conditions": {"contain": "inner"}, "check_archive": True, "action": {"type": "move", "target": "/kept"},
     "delete_unpacked_on_match": True},
    {"name": "old", "conditions": {"end": ".tmp"}, "action": {"type": "delete"}},
    {"name": "dirs", "is_directory": True, "conditions": {"start": "big", "larger": "9B"}, "action": {"type": "move", "target": "/kept"}},
]
RUN = [("/w", "d.zip", 1, T[0], False), ("/w/d", "inner", 4, T[0], False), ("/w/d/s", "more", 4, T[0], False),
       ("/w", "a.tmp", 1, T[0], False), ("/w", "b.tmp", 1, T[0], False), ("/w/big1", "x", 6, T[0], False),
       ("/w/big1/k", "x", 6, T[0], False), ("/w/big2", "x", 6, T[0], False), ("/kept", "big1", 0, T[0], False),
       ("/w", ".h.tmp", 1, T[0], False)]


def _run(spark, **flags):
    members = spark.createDataFrame([("/w/d.zip", "inner", 4), ("/w/d.zip", "s/more", 4)], "archive string, member string, size bigint")
    return R.organize(world(spark, RUN), RULES, T[8], base="/w", members=members, **flags)


def test_whole_run_over_a_directory(spark):
    run = _run(spark, always_delete=True)
    plan = {r.path: (r.action_type, r.final_path) for r in run.plan.collect()}
    assert plan == {"/w/d.zip": ("move", "/kept/d.zip"), "/w/a.tmp": ("delete", None), "/w/b.tmp": ("delete", None),
                    "/w/big1": ("move", "/kept/big1_1")}
    assert run.stats.first().asDict() == {"total_files": 6, "processed_files": 4, "skipped_files": 2, "errors": 0}
    assert [(r.dir, r.status) for r in run.cleanup.collect()] == [("/w/d", "removed")]
    assert {r.path for r in run.after.collect()} == {"/kept/d.zip", "/kept/big1_1/x", "/kept/big1_1/k/x", "/w/big2/x", "/kept/big1", "/w/.h.tmp"}


def test_run_asks_for_deletes_and_clean_up(spark):
    seq = {r.path: r.seq for r in _run(spark, dry_run=True).plan.collect()}
    said = spark.createDataFrame([(seq["/w/a.tmp"], "y"), (seq["/w/b.tmp"], "n")], "id bigint, resp string")
    run = _run(spark, answers=said)
    assert {r.path: r.decision for r in run.plan.collect()} == {"/w/d.zip": True, "/w/a.tmp": True, "/w/b.tmp": False, "/w/big1": True}
    assert run.cleanup.first().status == "kept"
    yes = spark.createDataFrame([("/w/d.zip", "")], "id string, resp string")
    assert _run(spark, answers=said, cleanup_answers=yes).cleanup.first().status == "removed"
    dry = _run(spark, dry_run=True)
    assert dry.cleanup.count() == 0 and dry.after.count() == len(RUN)


STREAM_RULES = [{"name": "old", "conditions": {"older": "1d"}, "action": {"type": "delete"}}]


def test_stream_epochs_have_their_own_instant_and_replay_alike(spark, tmp_path):
    schema = "parent string, name string, size bigint, mtime timestamp, is_directory boolean"
    rows = world(spark, [("/p", f"n{i}", i, T[0], False) for i in range(12)])
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.repartition(3).write.parquet(src)
    first = S.match_stream(spark, src, _parse_datatype_string(schema), lambda d: d, STREAM_RULES, out_dir=out, with_epoch=True).collect()
    assert sorted(r.name for r in first) == sorted(f"n{i}" for i in range(12)) and len({r.epoch for r in first}) == 3
    assert all(r.rule_idx == 0 for r in first)
    epochs = {r.epoch: r.as_of for r in S.read_epochs(spark, out).collect()}
    # an epoch run again: its recorded instant holds, and no row is added
    batch = spark.createDataFrame([(r.parent, r.name, r.size, r.mtime, r.is_directory) for r in first if r.epoch == 1], schema)
    S.append_epoch(batch, 1, out, lambda d: d, STREAM_RULES, now=lambda: 0)
    again = S.match_stream(spark, src, _parse_datatype_string(schema), lambda d: d, STREAM_RULES, out_dir=out, with_epoch=True).collect()
    assert sorted(again) == sorted(first)
    assert {r.epoch: r.as_of for r in S.read_epochs(spark, out).collect()} == epochs


def test_stream_instant_is_that_of_the_batch(spark, tmp_path):
    at = [int(T[0].timestamp()) * 1_000_000 + d * 86_400_000_000 for d in (0, 2)]
    batch = world(spark, [("/p", "n", 1, T[0], False)])
    for epoch, now in enumerate(at):
        S.append_epoch(batch, epoch, str(tmp_path), lambda d: d, STREAM_RULES, now=lambda: now)
    rows = spark.read.parquet(os.path.join(tmp_path, "table")).orderBy("batch").select("rule_idx").collect()
    assert [r.rule_idx for r in rows] == [None, 0]
    assert S.epoch_instant(spark, str(tmp_path), 0, now=lambda: 5) == at[0]
