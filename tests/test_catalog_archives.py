"""Rule-catalog checks (V*), archives as bytes (S7, S11, U2), streaming."""

import io
import zipfile

from pyspark.sql import functions as F

from lakerules.operators import catalog as Ca
from lakerules.sources import archives as Ar

ROWS = "ruleset string, rule_idx int, name string, cond_key string, cond_value string, action_type string, target string"


def _checks(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    return {(r.rule_num, r.rule_id, r.check) for r in Ca.rule_checks(df).collect()}


def test_valid_rule_has_no_errors(spark):
    rows = [("s", 0, "ok", "end", ".log", "delete", None), ("s", 0, "ok", "older", "30d", "delete", None),
            ("s", 1, None, "regex", r"^a\d+", "move", "dest")]
    assert _checks(spark, rows) == set()


def test_each_check(spark):
    rows = [("s", 0, "", "bigger", "1", "shred", None),            # V5 blank name, V10, V18
            ("s", 1, "x" * 201, "larger", "1.5.5GB", "move", None),  # V6, V12, V19
            ("s", 2, None, "older", "5y", "compress", "../up"),      # V13, V21
            ("s", 3, "r", "regex", "(unclosed", "delete", None),     # V14
            ("s", 4, "e", "start", "", None, "t"),                   # V11, V17
            ("s", 5, "n", None, None, None, None)]                   # V9, V15
    got = _checks(spark, rows)
    assert got == {(1, "#1", "V5"), (1, "#1", "V10"), (1, "#1", "V18"),
                   (2, "x" * 201, "V6"), (2, "x" * 201, "V12"), (2, "x" * 201, "V19"),
                   (3, "#3", "V13"), (3, "#3", "V21"), (4, "r", "V14"), (5, "e", "V11"), (5, "e", "V17"),
                   (6, "n", "V9"), (6, "n", "V15")}


def test_extra_check_and_counts(spark):
    df = spark.createDataFrame([("s", 0, None, "end", ".x", "delete", None), ("t", 0, "fine", "end", ".x", "delete", None)], ROWS)
    checks = Ca.rule_checks(df, extra=[("unnamed", lambda flat: F.col("name").isNull())])
    assert {(r.ruleset, r.check) for r in checks.collect()} == {("s", "unnamed")}
    assert {r.ruleset: r.n_errors for r in Ca.rule_check_counts(checks, df).collect()} == {"s": 1, "t": 0}


def test_flag_types():
    assert Ca.check_flags({"case_sensitive": "yes", "is_directory": True}) == ["'case_sensitive' must be boolean"]


def _zip(entries):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return buf.getvalue()


def test_zip_listing_and_corrupt_archive(spark):
    good = _zip([("file.txt", "content"), ("empty_dir/", ""), ("nested/file.txt", "more content.."),
                 ("zero.txt", ""), ("fißéñâme.txt", "x"), ("space name.txt", "y")])
    df = spark.createDataFrame([("/a/good.zip", bytearray(good)), ("/a/bad.zip", bytearray(b"not a zip"))],
                               "archive string, content binary")
    rows = Ar.list_members(df).collect()
    good_rows = {(r.member, r.size) for r in rows if r.archive == "/a/good.zip"}
    assert good_rows == {("file.txt", 7), ("empty_dir/", 0), ("nested/file.txt", 14), ("zero.txt", 0),
                         ("fißéñâme.txt", 1), ("space name.txt", 1)}
    bad = [r for r in rows if r.archive == "/a/bad.zip"]
    assert len(bad) == 1 and bad[0].member is None and bad[0].error


def test_pack_then_list_roundtrip_and_custom_reader(spark):
    rows = spark.createDataFrame([("/o/a.zip", "a/x.txt", bytearray(b"hello")), ("/o/a.zip", "a/e/", None),
                                  ("/o/b.zip", "b.txt", bytearray(b"!"))], "archive string, member string, content binary")
    packed = Ar.pack_groups(rows)
    listed = {(r.archive, r.member, r.size) for r in Ar.list_members(packed).collect()}
    assert listed == {("/o/a.zip", "a/e/", 0), ("/o/a.zip", "a/x.txt", 5), ("/o/b.zip", "b.txt", 1)}
    tars = Ar.pack_groups(rows.withColumn("archive", F.regexp_replace("archive", "zip$", "tar")), fmt="tar")
    readers = Ar.default_readers() + [(".tar", Ar.read_tar)]
    listed = {(r.archive, r.member) for r in Ar.list_members(tars, readers).collect()}
    assert listed == {("/o/a.tar", "a/e/"), ("/o/a.tar", "a/x.txt"), ("/o/b.tar", "b.txt")}


def test_failing_reader_is_skipped(spark):
    def broken(_data):
        raise RuntimeError("boom")
    df = spark.createDataFrame([("/a/x.zip", bytearray(_zip([("f", "1")])))], "archive string, content binary")
    rows = Ar.list_members(df, readers=[(".zip", broken), (".zip", Ar.read_zip)]).collect()
    assert [(r.member, r.size) for r in rows] == [("f", 1)]


def test_unreadable_archive_is_never_identical(spark):
    from lakerules.plans import cleanup as Cl
    from lakerules.plans import decisions as Dc
    members = spark.createDataFrame([("/x/bad.zip", None, None, None, "BadZipFile: not a zip")],
                                    "archive string, member string, size bigint, pos bigint, error string")
    dirfiles = spark.createDataFrame([("/x/bad", ".hidden_only", 1)], "dir string, rel string, size bigint")
    c = Cl.compared_pairs(members, dirfiles)
    out = Cl.cleanup_plan(c, Dc.AUTOMATIC, always_delete=True).collect()
    assert [(r.identical, r.status, r.decision) for r in out] == [(False, "unreadable", False)]


def test_scan_files_reads_metadata(spark, tmp_path):
    from lakerules.sources.inventory import scan_files
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("1234567")
    (tmp_path / "sub" / "b.log").write_text("12")
    rows = {(r.name, r.size) for r in scan_files(spark, str(tmp_path)).collect()}
    assert rows == {("a.txt", 7), ("b.log", 2)}


def test_json_catalog_checks(spark):
    import json
    from lakerules.operators.catalog_json import rule_checks_json
    sets = {
        "good": [{"name": "ok", "conditions": {"end": ".log", "older": "30d"}, "action": {"type": "delete"},
                  "check_archive": False}],
        "notlist": {"a": 1},
        "empty": [],
        "bad": ["text", {"name": 3, "conditions": {"larger": 512}, "action": {"type": "move", "target": 7}},
                {"conditions": [], "action": {}, "name": "   "},
                {"name": "r", "conditions": {"regex": "(", "bigger": "1", "start": ""}, "action": "delete",
                 "is_directory": "yes"},
                {"conditions": {"larger": "1.5.5GB", "newer": "3y"}, "action": {"type": "shred"}},
                {"conditions": {"end": ".x"}, "action": {"type": "compress", "target": "../up"}, "description": 5}],
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in sets.items()], "ruleset string, rules_json string")
    got = {(r.ruleset, r.rule_num, r.check) for r in rule_checks_json(df).collect()}
    assert got == {("notlist", None, "V1"), ("empty", None, "V2"),
                   ("bad", 1, "V3"), ("bad", 2, "V4"), ("bad", 2, "V20"),
                   ("bad", 3, "V5"), ("bad", 3, "V8"),
                   ("bad", 4, "V14"), ("bad", 4, "V10"), ("bad", 4, "V11"), ("bad", 4, "V16"), ("bad", 4, "V22"),
                   ("bad", 5, "V12"), ("bad", 5, "V13"), ("bad", 5, "V18"),
                   ("bad", 6, "V7"), ("bad", 6, "V21")}
