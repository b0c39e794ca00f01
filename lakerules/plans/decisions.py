"""Execution modes, approvals and decisions.

The interactive prompt of the original becomes an *answers table* ``(id, key, resp)``: one answer
per prompt, ``id`` = the prompted row's ``seq``. An answer ``a`` or ``never`` sticks to its key:
every later prompt of that key is decided without reading its own answer. The first sticky
answer per key is a plain aggregate (partial before the shuffle, so a hot key is cheap) joined
back to the prompts -- no per-key window over all prompts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Execution modes and the answers a prompt accepts (blank means "y").
DRY_RUN, AUTOMATIC, INTERACTIVE = "dry_run", "automatic", "interactive"
VALID_ANSWERS = ("y", "n", "a", "never")
STICKY_ANSWERS = ("a", "never")
DEFAULT_ANSWER = "y"


def organize_mode(dry_run: bool = False, always_delete: bool = False, never_delete: bool = False) -> str:
    """Mode of an organise run: dry run wins, then always/never -> automatic, else interactive."""
    if always_delete and never_delete:
        raise ValueError("always_delete and never_delete cannot both be set")
    if dry_run:
        return DRY_RUN
    if always_delete or never_delete:
        return AUTOMATIC
    return INTERACTIVE


def cleanup_mode(always_delete: bool = False, never_delete: bool = False) -> str:
    """Mode of a clean-up run: never -> dry run, always -> automatic, else interactive."""
    if always_delete and never_delete:
        raise ValueError("always_delete and never_delete cannot both be set")
    if never_delete:
        return DRY_RUN
    if always_delete:
        return AUTOMATIC
    return INTERACTIVE


def normalize_answers(answers: DataFrame) -> DataFrame:
    """Lower-case, trimmed answers; blank -> 'y'; invalid answers are dropped (re-asked)."""
    r = F.lower(F.trim(F.col("resp")))
    r = F.when((r == "") | r.isNull(), F.lit(DEFAULT_ANSWER)).otherwise(r)
    return answers.withColumn("resp", r).filter(F.col("resp").isin(*VALID_ANSWERS))


def approvals(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Decision per prompt.

    prompts: ``id, key`` (rows needing an answer, in ``id`` order within a key);
    answers: ``id, resp``. Output: ``id, key, resp, sticky, approved`` where ``sticky`` marks a
    prompt decided by an earlier ``a``/``never`` of its key; unanswered prompts are not approved.
    """
    a = normalize_answers(answers.select("id", "resp"))
    p = prompts.select("id", "key").join(a, "id", "left")
    first_sticky = (p.filter(F.col("resp").isin(*STICKY_ANSWERS))
                    .groupBy("key").agg(F.min_by("resp", "id").alias("sticky_resp"), F.min("id").alias("sticky_id")))
    j = p.join(first_sticky, "key", "left")
    sticky = F.coalesce(F.col("id") > F.col("sticky_id"), F.lit(False))
    eff = F.when(sticky, F.col("sticky_resp")).otherwise(F.col("resp"))
    return j.select("id", "key", "resp", sticky.alias("sticky"),
                    F.coalesce(eff.isin("y", "a"), F.lit(False)).alias("approved"))


def decide(action_type, mode: str, always_delete: bool = False, approved: Column | None = None) -> Column:
    """M5: dry run never executes; automatic runs non-deletes and deletes only when allowed;
    interactive runs non-deletes and deletes that were approved."""
    is_delete = F.coalesce(F.col(action_type) == "delete", F.lit(False)) if isinstance(action_type, str) \
        else F.coalesce(action_type == "delete", F.lit(False))
    if mode == DRY_RUN:
        return F.lit(False)
    if mode == AUTOMATIC:
        return F.when(is_delete, F.lit(bool(always_delete))).otherwise(F.lit(True))
    if mode == INTERACTIVE:
        ok = approved if approved is not None else F.lit(False)
        return F.when(is_delete, F.coalesce(ok, F.lit(False))).otherwise(F.lit(True))
    raise ValueError(f"unknown mode {mode!r}")
