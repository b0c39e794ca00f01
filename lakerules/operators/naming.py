"""Collision-free target names.

Sequential rule being reproduced: claims are served in ``seq`` order; a claim takes its wanted
name when free, otherwise ``<stem>_<j><suffix>`` for the lowest free ``j >= 1``. A name held by an
existing entry may be released at a given ``seq``, when its holder leaves in the same run; later
claims may take it.

Candidates of a name keep its *name key* (the name with the ``(_<digits>)+`` run before the last
extension, or at the end, removed), so claims can only interact inside one (dir, key) group. Groups
where no claim collides keep their names. In the others:

1. A slot string ``<stem>_<j><suffix>`` belongs to one wanted name, its *parent* (``a.txt`` ->
   ``a_1.txt`` -> ``a_1_2.txt``). To a name's claims, a slot is available from the release of its
   holder until the first claim that wants that very string: by then either has it. Both instants are
   known beforehand, so every wanted name can be served without knowing what became of the others.
2. Instants become ranks: :func:`running_count` counts a name's claims before each of them, in the
   same pass that ranks the claims. It splits a hot name over many tasks.
3. Each name then is a stream of its *special* slots (held, or wanted as names themselves), from which
   :func:`serve` makes runs "claims i..k take slots j, j+1, ...". Claims are not read for that.
4. Whether a name's own string is still free when it is first wanted depends on its parent's
   outcome, a boolean. Linked names are served under both answers, and the chain of booleans is composed
   by pointer jumping over parent links: rounds grow with the logarithm of the longest chain.
5. A claim meets its run within blocks of ``BLOCK`` ranks, so no name's claims meet all its runs.

Only groups with names such as ``b._1`` or ``b.``, whose slots can have two parents, are folded in
claim order, one group per call.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import _c, py_stem, py_suffix, stem_of, suffix_of
from ..session import cut_lineage

NEVER = (1 << 63) - 1  # a rank or instant that does not come
BLOCK = 4096

NAME_KEY_RE = r"(_[0-9]+)+(?=\.[^.]*$|$)"


def name_key(name) -> Column:
    return F.regexp_replace(_c(name), NAME_KEY_RE, "")


def candidate(name, j) -> Column:
    """``name`` itself for slot 0, else ``<stem>_<j><suffix>``."""
    name, j = _c(name), _c(j)
    return F.when(j == 0, name).otherwise(F.concat(stem_of(name), F.lit("_"), j.cast("string"), suffix_of(name)))


def slot_of(name, occupied) -> Column:
    """Slot number of ``occupied`` among the candidates of ``name`` (NULL when not a candidate)."""
    name, occ = _c(name), _c(occupied)
    stem, suf = stem_of(name), suffix_of(name)
    mid = F.substring(occ, F.length(stem) + 2, F.length(occ) - F.length(stem) - F.length(suf) - 1)
    is_cand = (occ.startswith(F.concat(stem, F.lit("_"))) & occ.endswith(suf)
               & (F.length(occ) > F.length(stem) + F.length(suf) + 1) & mid.rlike(r"^[1-9][0-9]*$")
               & (F.concat(stem, F.lit("_"), mid, suf) == occ))
    return F.when(occ == name, F.lit(0).cast("bigint")).when(is_cand, mid.try_cast("bigint"))


ODD_NAME_RE = r"\._[0-9]+$"


def parents(name) -> Column:
    """The (name, j) pairs of which ``name`` is candidate slot j >= 1 (at most two)."""
    x = _c(name)
    st, sx = stem_of(x), suffix_of(x)
    j1 = F.regexp_extract(st, r"_([1-9][0-9]*)$", 1).try_cast("bigint")
    w1 = F.concat(F.regexp_replace(st, r"_[1-9][0-9]*$", ""), sx)
    j2 = F.regexp_extract(x, r"_([1-9][0-9]*)$", 1).try_cast("bigint")
    w2 = F.regexp_replace(x, r"_[1-9][0-9]*$", "")
    c1 = F.when((sx != "") & j1.isNotNull() & (candidate(w1, j1) == x), F.struct(w1.alias("name"), j1.alias("j")))
    c2 = F.when(j2.isNotNull() & (candidate(w2, j2) == x), F.struct(w2.alias("name"), j2.alias("j")))
    return F.array_distinct(F.filter(F.array(c1, c2), lambda v: v.isNotNull()))


def running_count(df: DataFrame, keys: list[str], order: list[str], weight: str) -> DataFrame:
    """``df`` + ``count``: the sum of ``weight`` up to and with each row within ``keys`` by ``order``,
    without a hot task.

    Rows are range-partitioned on keys and order, so a huge group is cut into slices; each is summed
    up by itself, and the totals of the slices before it (a small table) are added.
    """
    # the slice ids are written once: both branches below (and any retry after a lost executor)
    # see the same assignment, even if range bounds were sampled again
    r = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = r.withColumn("_local", F.sum(weight).over(w))
    totals = r.groupBy(*keys, "_pid").agg(F.sum(weight).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.sum("_n").over(before)).drop("_n").filter("_off > 0")  # groups cut in two
    return (local.join(offsets, [*keys, "_pid"], "left")
            .withColumn("count", F.col("_local") + F.coalesce("_off", F.lit(0))).drop("_pid", "_local", "_off"))


def serve(specials: Iterator[tuple[int, int, int, bool]], n: int) -> Iterator[tuple[int, int, int, bool]]:
    """Serve ``n`` claims with the lowest slot available to each. ``specials`` are (slot, opens, closes,
    wanted) by slot: the claims ranked ``opens + 1`` to ``closes`` may take it; other slots are free.
    Yields runs (first claim, last claim, first slot, wanted)."""
    claim, front = 1, 0
    waiting: list[tuple] = []  # passed, but opening later
    open_behind: list[tuple] = []
    special = next(specials, None)
    while claim <= n:
        while waiting and waiting[0][0] < claim:
            _, slot, closes, wanted = heapq.heappop(waiting)
            heapq.heappush(open_behind, (slot, closes, wanted))
        while open_behind and open_behind[0][1] < claim:
            heapq.heappop(open_behind)
        if open_behind:
            slot, _, wanted = heapq.heappop(open_behind)
            yield claim, claim, slot, wanted
            claim += 1
        elif special is not None and special[0] == front:
            slot, opens, closes, wanted = special
            special, front = next(specials, None), front + 1
            if opens < claim <= closes:
                yield claim, claim, slot, wanted
                claim += 1
            elif claim <= opens < NEVER:
                heapq.heappush(waiting, (opens, slot, closes, wanted))
        else:
            most = n - claim + 1
            if special is not None:
                most = min(most, special[0] - front)
            if waiting:
                most = min(most, waiting[0][0] - claim + 1)
            yield claim, claim + most - 1, front, False
            claim, front = claim + most, front + most


_RUNS = pa.schema([("dir", pa.string()), ("name", pa.string()), ("own_free", pa.bool_()), ("low", pa.int64()),
                   ("high", pa.int64()), ("slot", pa.int64()), ("wanted", pa.bool_())])


def _serve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``dir, name, own_free, slot, opens, closes, wanted, n`` in order -> runs of every name."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    held: list[tuple] = []
    for name, group in groupby(rows, key=lambda r: r[:3]):
        first = next(group)
        specials = iter([first[3:7]])
        for run in serve((s for part in (specials, (r[3:7] for r in group)) for s in part), first[7]):
            held.append((*name, *run))
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _RUNS)], schema=_RUNS)
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _RUNS)], schema=_RUNS)


def _fold_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sequential resolution inside one (dir, key) group: occupied rows have claim_id NULL."""
    taken, leaving, out = set(), [], []
    for name, release in zip(*(pdf.loc[pdf["claim_id"].isna(), c] for c in ("name", "release"))):
        taken.add(name)
        heapq.heappush(leaving, (release, name))
    claims = pdf[pdf["claim_id"].notna()].sort_values(["seq", "claim_id"], kind="stable")
    for cid, seq, name in zip(claims["claim_id"], claims["seq"], claims["name"]):
        while leaving and leaving[0][0] < seq:
            taken.discard(heapq.heappop(leaving)[1])
        final, j = name, 0
        while final in taken:
            j += 1
            final = f"{py_stem(name)}_{j}{py_suffix(name)}"
        taken.add(final)
        out.append((int(cid), final))
    return pd.DataFrame(out, columns=["claim_id", "final_name"])


def _special_slots(strings: DataFrame) -> DataFrame:
    """``dir, name, slot, release, first, wanted`` of every special slot of the wanted names, and of slot
    0 of each: when its holder leaves (null: there is none), and the first claim of that very string."""
    names = strings.filter("n > 0").select("dir", "name")
    below = (strings.select("dir", F.explode(parents("name")).alias("p"), "release", "first", (F.col("n") > 0).alias("wanted"))
             .select("dir", F.col("p.name").alias("name"), F.col("p.j").alias("slot"), "release", "first", "wanted")
             .join(names, ["dir", "name"], "left_semi"))
    own = strings.filter("n > 0").select("dir", "name", F.lit(0).cast("bigint").alias("slot"), "release",
                                         F.lit(None).cast(strings.schema["first"].dataType).alias("first"), F.lit(False).alias("wanted"))
    return below.unionByName(own)


def _own_string_free(links: DataFrame, runs: DataFrame, chain: int) -> DataFrame:
    """``dir, name, own_free`` of linked names: is a name's string left to it by its parent?

    ``links``: ``dir, name, parent, slot``, in chains of at most ``chain``. A link maps the parent's
    answer to the name's; maps are composed over twice the distance in each round.
    """
    took = runs.filter("wanted").groupBy("dir", F.col("name").alias("parent"), "slot").agg(
        F.bool_or(~F.col("own_free")).alias("took_0"), F.bool_or("own_free").alias("took_1"))
    left = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    maps = links.join(took, ["dir", "parent", "slot"], "left").select(
        "dir", "name", F.col("parent").alias("up"), left("took_0").alias("if_0"), left("took_1").alias("if_1"))
    for _ in range(math.ceil(math.log2(chain)) if chain > 1 else 0):
        maps = cut_lineage(maps)
        above = maps.select("dir", F.col("name").alias("up"), F.col("up").alias("up2"), F.col("if_0").alias("u0"), F.col("if_1").alias("u1"))
        through = lambda u: F.when(F.col(u).isNull(), F.lit(None)).when(F.col(u), F.col("if_1")).otherwise(F.col("if_0"))
        maps = maps.join(above, ["dir", "up"], "left").select(
            "dir", "name", F.coalesce("up2", "up").alias("up"),
            F.coalesce(through("u0"), "if_0").alias("if_0"), F.coalesce(through("u1"), "if_1").alias("if_1"))
    # the topmost name has no parent to lose its string to
    return maps.select("dir", "name", F.col("if_1").alias("own_free"))


def resolve_names(claims: DataFrame, occupied: DataFrame, claims_are_cut: bool = False) -> DataFrame:
    """Final name per claim.

    claims: ``claim_id, seq, dir, name``; occupied: ``dir, name`` (entries already present), and
    optionally ``release``, the ``seq`` at which the holder leaves (null: it stays).
    Output: ``claim_id, final_name``.

    Only occupied names inside directories that receive claims matter, so ``occupied`` is first
    narrowed by a semi-join. Inputs of several steps are written once in ``spark.checkpoint.dir``.
    """
    cl = claims.select("claim_id", "seq", "dir", "name")
    if not claims_are_cut:
        cl = cut_lineage(cl)
    released = "release" in occupied.columns
    occ = (occupied.select("dir", "name", (F.coalesce("release", F.lit(NEVER)) if released else F.lit(NEVER)).cast("bigint").alias("release"))
           .join(cl.select("dir").distinct(), "dir", "left_semi"))

    # per string that is claimed or held: its claims, when its holder leaves, and the first claim that
    # could get it
    none = F.lit(None).cast("bigint")
    strings = (cl.select("dir", "name", "seq", "claim_id", none.alias("release"))
               .unionByName(occ.select("dir", "name", none.alias("seq"), none.alias("claim_id"), "release"))
               .groupBy("dir", "name").agg(F.count("claim_id").alias("n"), F.max("release").alias("release"),
                                           F.min(F.when(F.col("claim_id").isNotNull(), F.struct("seq", "claim_id"))).alias("first")))
    if released:
        later = (cl.join(strings.filter((F.col("n") > 0) & (F.col("release") < NEVER)).select("dir", "name", "release"), ["dir", "name"])
                 .filter(F.col("seq") > F.col("release")).groupBy("dir", "name").agg(F.min(F.struct("seq", "claim_id")).alias("later")))
        strings = strings.join(later, ["dir", "name"], "left")
    else:
        strings = strings.withColumn("later", F.lit(None).cast(strings.schema["first"].dataType))
    strings = strings.withColumn("first", F.when(F.col("release").isNull(), F.col("first")).otherwise(F.col("later"))).drop("later")
    strings = cut_lineage(strings.withColumn("key", name_key("name")))
    collides = (F.col("n") > 1) | ((F.col("n") > 0) & F.col("release").isNotNull())
    odd = F.col("name").rlike(ODD_NAME_RE) | F.col("name").endswith(".")
    groups = strings.groupBy("dir", "key").agg(
        F.bool_or(collides).alias("hot"), F.bool_or(odd & (F.col("n") > 0)).alias("odd"),
        F.max(F.when(F.col("n") > 0, F.size(F.regexp_extract_all("name", F.lit(r"_[0-9]+"), F.lit(0))))).alias("chain"))
    groups = groups.filter("hot")
    seen = groups.agg(F.count(F.lit(1)).alias("hot"), F.bool_or("odd").alias("odd"), F.max(F.when(~F.col("odd"), F.col("chain"))).alias("chain")).first()
    if not seen["hot"]:  # no collision anywhere: every claim keeps its name
        return cl.select("claim_id", F.col("name").alias("final_name"))
    chain = seen["chain"] or 0
    grouped = strings.join(groups.select("dir", "key", "odd"), ["dir", "key"], "left")
    # 'b._1' and 'b_2.' share the slot 'b_2._1'; everywhere else a slot belongs to one wanted name
    calm = grouped.filter(F.col("odd").isNull() & (F.col("n") > 0)).select("dir", "name")
    strings = grouped.filter(~F.col("odd"))
    wanted = strings.filter("n > 0")
    out = cl.join(calm, ["dir", "name"], "left_semi").select("claim_id", F.col("name").alias("final_name"))

    # claims and instants, ranked together
    special = _special_slots(strings)
    instants = released or chain > 0
    ticks = cl.join(wanted.select("dir", "name"), ["dir", "name"], "left_semi").select(
        "dir", "name", "seq", F.col("claim_id").alias("tie"), F.lit("claim").alias("kind"), F.lit(1).alias("weight"), none.alias("slot"))
    if instants:
        tick = lambda kind: [F.lit(kind).alias("kind"), F.lit(0).alias("weight"), "slot"]
        ticks = (ticks.unionByName(special.filter(F.col("release") < NEVER).select(
                     "dir", "name", F.col("release").alias("seq"), F.lit(NEVER).alias("tie"), *tick("open")))
                 .unionByName(special.filter("first is not null").select(
                     "dir", "name", F.col("first.seq").alias("seq"), F.col("first.claim_id").alias("tie"), *tick("close"))))
    ranked = running_count(ticks, ["dir", "name"], ["seq", "tie", "kind"], "weight")

    # every name served: with its string free, and where it has a parent also with its string gone
    slots = special.join(wanted.select("dir", "name", "n"), ["dir", "name"])
    if instants:
        bounds = ranked.filter("kind <> 'claim'").groupBy("dir", "name", "slot").agg(
            F.max(F.when(F.col("kind") == "open", F.col("count"))).alias("opens"),
            F.max(F.when(F.col("kind") == "close", F.col("count"))).alias("closes"))
        slots = slots.join(bounds, ["dir", "name", "slot"], "left")
    else:
        slots = slots.withColumn("opens", none).withColumn("closes", none)
    answers = F.array(F.lit(True))
    if chain:
        links = (wanted.select("dir", "name", F.explode(parents("name")).alias("p"))
                 .select("dir", "name", F.col("p.name").alias("parent"), F.col("p.j").alias("slot"))
                 .join(wanted.select("dir", F.col("name").alias("parent")), ["dir", "parent"], "left_semi"))
        slots = slots.join(links.select("dir", "name", F.lit(True).alias("linked")), ["dir", "name"], "left")
        answers = F.when(F.col("linked"), F.array(F.lit(True), F.lit(False))).otherwise(answers)
    slots = slots.withColumn("own_free", F.explode(answers))
    opens = (F.when((F.col("slot") == 0) & ~F.col("own_free"), F.lit(NEVER)).when(F.col("release").isNull(), F.lit(0))
             .when(F.col("release") == NEVER, F.lit(NEVER)).otherwise(F.col("opens")))
    slots = slots.select("dir", "name", "own_free", "slot", opens.alias("opens"),
                         F.when(F.col("first").isNull(), F.lit(NEVER)).otherwise(F.col("closes")).alias("closes"), "wanted", "n")
    runs = slots.repartition("dir", "name", "own_free").sortWithinPartitions("dir", "name", "own_free", "slot").mapInArrow(
        _serve_batches, "dir string, name string, own_free boolean, low bigint, high bigint, slot bigint, wanted boolean")
    if chain:
        runs = cut_lineage(runs)
        answer = _own_string_free(links, runs, chain)
        runs = runs.join(answer.withColumnRenamed("own_free", "answer"), ["dir", "name"], "left").filter(
            F.col("own_free") == F.coalesce("answer", F.lit(True)))

    # claims meet their run inside blocks of ranks
    pieces = (runs.withColumn("block", F.explode(F.sequence(F.expr(f"low div {BLOCK}"), F.expr(f"high div {BLOCK}"))))
              .select("dir", "name", "block", F.greatest("low", F.col("block") * BLOCK).alias("rank"),
                      (F.col("slot") - F.col("low")).alias("shift"), F.lit(None).cast("bigint").alias("claim_id")))
    members = ranked.filter("kind = 'claim'").select(
        "dir", "name", F.expr(f"count div {BLOCK}").alias("block"), F.col("count").alias("rank"),
        F.lit(None).cast("bigint").alias("shift"), F.col("tie").alias("claim_id"))
    w = Window.partitionBy("dir", "name", "block").orderBy("rank", F.col("claim_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = members.unionByName(pieces).withColumn("shift", F.last("shift", ignorenulls=True).over(w)).filter("claim_id is not null")
    out = out.unionByName(placed.select("claim_id", candidate("name", F.col("rank") + F.col("shift")).alias("final_name")))

    if seen["odd"]:
        folded = grouped.filter("odd")
        rows = (cl.join(folded.filter("n > 0").select("dir", "key", "name"), ["dir", "name"])
                .select("dir", "key", "claim_id", "seq", "name", none.alias("release"))
                .unionByName(folded.filter("release is not null").select("dir", "key", none.alias("claim_id"), none.alias("seq"), "name", "release")))
        out = out.unionByName(rows.groupBy("dir", "key").applyInPandas(_fold_group, "claim_id bigint, final_name string"))
    return out


def py_resolve(claims: list[tuple], occupied: set[tuple], releases: dict | None = None) -> dict:
    """Plain sequential model (for tests): claims = [(claim_id, seq, dir, name)]; ``releases`` maps an
    occupied (dir, name) to the ``seq`` at which its holder leaves."""
    taken, leaving = set(occupied), sorted((s, n) for n, s in (releases or {}).items())
    out = {}
    for cid, seq, d, name in sorted(claims, key=lambda c: c[1]):
        while leaving and leaving[0][0] < seq:
            taken.discard(leaving.pop(0)[1])
        final, j = name, 0
        while (d, final) in taken:
            j += 1
            final = f"{py_stem(name)}_{j}{py_suffix(name)}"
        taken.add((d, final))
        out[cid] = final
    return out
