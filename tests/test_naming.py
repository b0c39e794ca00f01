"""Collision-free naming against a plain sequential model (random inputs)."""

import random

from lakerules.functions.columns import py_stem, py_suffix
from lakerules.operators.naming import py_resolve, resolve_names


def _random_case(rng, n_claims):
    bases = ["a.txt", "a_1.txt", "b", "b_2", "c.", "c._1", "d.tar.gz", ".rc", "e_1_1.txt", "f.txt"]
    dirs = ["/x", "/y"]
    occupied = set()
    for _ in range(rng.randint(0, 8)):
        n = rng.choice(bases)
        if rng.random() < 0.4:
            n = f"{py_stem(n)}_{rng.randint(1, 4)}{py_suffix(n)}"
        occupied.add((rng.choice(dirs), n))
    claims = [(i, rng.randint(0, 10_000), rng.choice(dirs), rng.choice(bases[:6] if rng.random() < .5 else bases))
              for i in range(n_claims)]
    # distinct seq values keep the sequential order unambiguous
    claims = [(c[0], c[1] * 100 + c[0], c[2], c[3]) for c in claims]
    return claims, occupied


def test_resolve_matches_sequential_model(spark):
    rng = random.Random(7)
    for trial in range(3):
        claims, occupied = _random_case(rng, 40 + trial * 20)
        cdf = spark.createDataFrame(claims, "claim_id long, seq long, dir string, name string")
        odf = spark.createDataFrame(sorted(occupied) or [("/none", "none")], "dir string, name string")
        got = {r.claim_id: r.final_name for r in resolve_names(cdf, odf).collect()}
        want = py_resolve(claims, occupied)
        assert got == want, trial


def test_single_name_closed_form(spark):
    # existing: t.dat and t_2.dat; five claims for t.dat -> t_1, t_3, t_4, t_5, t_6
    claims = [(i, i, "/d", "t.dat") for i in range(5)]
    occupied = {("/d", "t.dat"), ("/d", "t_2.dat")}
    cdf = spark.createDataFrame(claims, "claim_id long, seq long, dir string, name string")
    odf = spark.createDataFrame(sorted(occupied), "dir string, name string")
    got = {r.claim_id: r.final_name for r in resolve_names(cdf, odf).collect()}
    assert got == {0: "t_1.dat", 1: "t_3.dat", 2: "t_4.dat", 3: "t_5.dat", 4: "t_6.dat"}


def test_resolution_independent_of_partitioning(spark):
    from pyspark.sql import functions as F
    rng = random.Random(11)
    claims, occupied = _random_case(rng, 120)
    cdf = spark.createDataFrame(claims, "claim_id long, seq long, dir string, name string")
    odf = spark.createDataFrame(sorted(occupied) or [("/none", "none")], "dir string, name string")
    a = sorted(resolve_names(cdf, odf).collect())
    b = sorted(resolve_names(cdf.repartition(5).orderBy(F.rand(1)), odf.repartition(3)).collect())
    assert a == b


def test_name_trees_match_sequential_model(spark):
    rng = random.Random(23)
    bases = ["a.txt", "a_1.txt", "a_1_2.txt", "a_2.txt", "a_2_1_3.txt", "b.dat", "c", "c_3", "d.log",
             "e.", "e._1", "f_7.txt"]
    for trial in range(3):
        occupied = {("/z", rng.choice(bases)) for _ in range(rng.randint(0, 6))}
        occupied |= {("/z", f"a_{rng.randint(1, 6)}.txt") for _ in range(rng.randint(0, 3))}
        claims = [(i, rng.randint(0, 10 ** 6) * 1000 + i, "/z", rng.choice(bases)) for i in range(60 + 30 * trial)]
        cdf = spark.createDataFrame(claims, "claim_id long, seq long, dir string, name string")
        odf = spark.createDataFrame(sorted(occupied) or [("/none", "none")], "dir string, name string")
        got = {r.claim_id: r.final_name for r in resolve_names(cdf, odf).collect()}
        assert got == py_resolve(claims, occupied), trial


def test_released_names_match_sequential_model(spark):
    rng = random.Random(31)
    bases = ["a.txt", "a_1.txt", "a_1_2.txt", "a_3.txt", "b", "b_1", "b_1_1", "c.", "c._1", "d.log"]
    for trial in range(3):
        occupied, claims = set(), []
        for _ in range(rng.randint(2, 14)):
            n = rng.choice(bases)
            occupied.add(("/z", n if rng.random() < .5 else f"{py_stem(n)}_{rng.randint(1, 5)}{py_suffix(n)}"))
        claims = [(i, rng.randint(0, 10 ** 6) * 1000 + i, "/z", rng.choice(bases)) for i in range(30 + 30 * trial)]
        # no name is released at the instant of a claim
        releases = {o: rng.randint(0, 10 ** 6) * 1000 + 999 for o in sorted(occupied) if rng.random() < .7}
        cdf = spark.createDataFrame(claims, "claim_id long, seq long, dir string, name string")
        odf = spark.createDataFrame([(*o, releases.get(o)) for o in sorted(occupied)], "dir string, name string, release long")
        got = {r.claim_id: r.final_name for r in resolve_names(cdf, odf).collect()}
        assert got == py_resolve(claims, occupied, releases), trial


def test_long_chains_of_linked_names(spark):
    """Chains of ten names, each a slot of the one before: past any fixed number of rounds."""
    rng = random.Random(3)
    chain = ["x.txt"]
    for _ in range(10):
        chain.append(chain[-1].replace(".txt", f"_{rng.choice([1, 1, 2])}.txt"))
    for trial in range(2):
        claims = [(i, rng.randint(0, 10 ** 6) * 1000 + i, "/z", rng.choice(chain)) for i in range(80)]
        cdf = spark.createDataFrame(claims, "claim_id long, seq long, dir string, name string")
        odf = spark.createDataFrame([("/z", rng.choice(chain))], "dir string, name string")
        got = {r.claim_id: r.final_name for r in resolve_names(cdf, odf).collect()}
        assert got == py_resolve(claims, {tuple(r) for r in odf.collect()}), trial


def test_hot_linked_component_has_no_task_with_all_claims(spark):
    """3 000 claims of one name and one each of 600 of its slots, dealt over several parts and blocks."""
    claims = spark.range(3000).selectExpr("id as claim_id", "id * 2 as seq", "'/h' as dir", "'a.txt' as name").unionByName(
        spark.range(1, 601).selectExpr("id + 100000 as claim_id", "id * 7 + 1 as seq", "'/h' as dir", "concat('a_', id * 3, '.txt') as name"))
    got = {r.claim_id: r.final_name for r in resolve_names(claims, claims.select("dir", "name").limit(0)).collect()}
    assert got == py_resolve([tuple(r) for r in claims.collect()], set())
