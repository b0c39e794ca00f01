"""Whole runs over an inventory (M10, M8, M7): match, ask, decide, plan, clean up, count.

``organize`` and ``delete_unpacked`` start from an inventory table, with the members of its archives
and the answers to prompts as two more tables, and return DataFrames. Nothing is written but the
lineage cuts of the plan; the sinks carry out what the plan says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_archive, name_of, parent_of
from ..functions.rules import to_rules
from ..operators.match import match_rules
from ..session import cut_lineage
from ..sources.inventory import (archives_with_directory, collect_level, entries, entry_names, list_directories,
                                 self_and_ancestors)
from . import actions as P
from . import cleanup as Cl
from . import decisions as Dc


class Run:
    """What an organise run would do. ``matched`` and ``plan`` are tables; ``stats``, ``cleanup`` (None
    without members and a rule that asks for it) and ``after`` are worked out when first asked for."""

    def __init__(self, files: DataFrame, matched: DataFrame, plan: DataFrame, base: str | None,
                 clean: Callable[[], DataFrame] | None):
        self.matched, self.plan = matched, plan
        self._files, self._base, self._clean = files, base, clean

    @cached_property
    def stats(self) -> DataFrame:
        return P.run_stats(self.matched)

    @cached_property
    def cleanup(self) -> DataFrame | None:
        return self._clean() if self._clean else None

    @cached_property
    def after(self) -> DataFrame:
        after = P.after_state(self._files, self.plan, self._base)
        if self.cleanup is None:
            return after
        return _without(after, self.cleanup.filter(F.col("status") == Cl.REMOVED).select(F.col("dir").alias("_gone")).distinct())


def delete_answers(planned: DataFrame, answers: DataFrame) -> DataFrame:
    """``seq, approved`` of the deletes in ``planned``: prompts are keyed by rule and asked in order
    of ``seq``. Entries that share a ``seq`` are all approved or none."""
    prompts = planned.filter((F.col("action_type") == "delete") & (F.col("status") == P.PLANNED))
    prompts = prompts.select(F.col("seq").alias("id"), F.col("rule_idx").alias("key")).distinct()
    return (Dc.approvals(prompts, _one_answer(answers)).groupBy(F.col("id").alias("seq"))
            .agg(F.bool_and("approved").alias("approved")))


def _one_answer(answers: DataFrame) -> DataFrame:
    """One answer per id; of several the least, so that a rerun reads the same one."""
    return answers.groupBy("id").agg(F.min("resp").alias("resp"))


def directory_answers(compared: DataFrame, answers: DataFrame) -> DataFrame:
    """``archive, approved`` for every pair, as if identical pairs were asked for one after the other
    in the order of their archives; ``answers``: ``id`` (the archive's path), ``resp``.

    The key of a prompt is the directory that holds the pair: an ``a`` or ``never`` settles all later
    pairs there. A pair whose directory an earlier answer removes is not asked, so its answer does
    not count. Pairs of a directory are at most the archive formats, so its window is small.
    """
    asked = compared.filter(F.col("identical") & ~F.col("has_hidden")).select(F.col("archive").alias("id"), "dir")
    resp = Dc.normalize_answers(_one_answer(answers))
    earlier = Window.partitionBy("dir").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    removed = F.coalesce(F.max(F.col("resp").isin("y", "a")).over(earlier), F.lit(False))
    live = asked.join(resp, "id", "left").withColumn("_removed", removed)
    counted = live.filter(~F.col("_removed") & F.col("resp").isNotNull()).select("id", "resp")
    prompts = asked.select("id", parent_of("dir").alias("key"))
    return Dc.approvals(prompts, counted).select(F.col("id").alias("archive"), "approved")


def _listing(inventory: DataFrame, pairs: DataFrame) -> DataFrame:
    """Listing of the paired directories, written once: the comparison reads it twice."""
    return cut_lineage(list_directories(inventory, pairs, include_hidden=True).select("dir", "rel", "size"))


def delete_unpacked(inventory: DataFrame, members: DataFrame, answers: DataFrame | None = None, *,
                    always_delete: bool = False, never_delete: bool = False) -> DataFrame:
    """Clean-up plan for a whole inventory: every archive with its unpacked directory beside it, at any
    depth, compared and decided (M8). Columns as :func:`cleanup.cleanup_plan`.

    ``members``: ``archive`` (full path), ``member, size`` and optionally ``pos, error``. An archive
    that lists no members differs from a directory with files. Without flags each identical pair
    waits for its answer (see :func:`directory_answers`), and an unanswered one is kept.
    """
    mode = Dc.cleanup_mode(always_delete, never_delete)
    pairs = cut_lineage(archives_with_directory(inventory))
    listing = _listing(inventory, pairs)
    compared = Cl.compared_pairs(members, listing, pairs)
    if mode != Dc.INTERACTIVE or answers is None:
        return Cl.cleanup_plan(compared, mode, always_delete)
    compared = cut_lineage(compared)  # a row per pair, read by the prompts and by the plan
    return Cl.cleanup_plan(compared, mode, approved=directory_answers(compared, answers))


def organize(inventory: DataFrame, rules, as_of, *, base: str | None = None, include_hidden: bool = False,
             members: DataFrame | None = None, answers: DataFrame | None = None,
             cleanup_answers: DataFrame | None = None, known_dirs: DataFrame | None = None,
             dry_run: bool = False, always_delete: bool = False, never_delete: bool = False,
             custom: dict[str, Callable] | None = None, reuse_released: bool = False) -> Run:
    """One run of ``rules`` over ``inventory`` (files: ``parent, name, size, mtime`` and optionally
    ``seq``).

    - ``base`` None: every row is an entry. Else the entries are the files and directories directly in
      ``base``, directories with the size and time of all below them; ``known_dirs`` (``path``) adds
      empty ones.
    - ``members`` lets ``check_archive`` rules look into archives and the clean-up compare them.
    - ``answers`` (``id`` = ``seq``, ``resp``) approves deletes per rule, ``cleanup_answers`` (``id`` =
      archive path, ``resp``) the removal of unpacked directories per parent directory; both count
      only without the flags. The flags choose the mode as :func:`decisions.organize_mode`.
    - ``stats`` counts every entry. ``after`` is the inventory that results, removed directories and
      all below them included.

    An empty inventory gives empty tables and zero counts.
    """
    rules = to_rules(rules)
    custom = P.register_actions(custom or {})
    mode = Dc.organize_mode(dry_run, always_delete, never_delete)
    files = inventory if "is_directory" in inventory.columns else inventory.withColumn("is_directory", F.lit(False))
    level = files
    if base is not None:
        b = base.rstrip("/")
        level = collect_level(entries(files.filter(~F.coalesce("is_directory", F.lit(False))), known_dirs), b, include_hidden=True)
    if not include_hidden:
        level = level.filter(~F.col("name").startswith("."))
    matched = match_rules(level, rules, as_of, members=members)
    approved = None
    if mode == Dc.INTERACTIVE and answers is not None:
        approved = delete_answers(P.plan_rows(matched, rules, custom), answers)
    occupied = entry_names(files)
    if known_dirs is not None:
        occupied = occupied.unionByName(known_dirs.select(parent_of("path").alias("parent"), name_of("path").alias("name")))
    plan = P.plan_actions(matched, rules, occupied, mode=mode, always_delete=always_delete, approved=approved,
                          custom=custom, reuse_released=reuse_released)
    plan = cut_lineage(plan)
    clean = None
    if members is not None and any(r.delete_unpacked_on_match for r in rules):
        clean = partial(_clean_up, files, plan, rules, members, mode, always_delete, cleanup_answers)
    return Run(files, matched, plan, base, clean)


def _clean_up(files, plan, rules, members, mode, always_delete, answers) -> DataFrame:
    flagged = [r.idx for r in rules if r.delete_unpacked_on_match]
    moved = plan.filter(F.col("decision") & (F.col("status") == P.PLANNED) & (F.col("action_type") == "move")
                        & ~F.col("is_directory") & is_archive("name") & F.col("rule_idx").isin(flagged))
    moved = cut_lineage(moved.select(F.col("path").alias("archive"), "final_path"))
    pairs = cut_lineage(archives_with_directory(files, moved))
    listing = _listing(files, pairs)
    compared = cut_lineage(Cl.compared_pairs(members, listing, pairs))
    approved = directory_answers(compared, answers) if mode == Dc.INTERACTIVE and answers is not None else None
    out = Cl.cleanup_plan(compared, mode, always_delete, approved)
    return cut_lineage(out.join(moved, "archive").select("archive", "final_path", "dir", "identical", "decision", "status"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` that neither are nor lie below a directory in ``gone``: their distinct parents are
    exploded to ancestors, not the rows."""
    rows = rows.withColumn("_parent", parent_of("path"))
    inside = (rows.select("_parent").distinct().select("_parent", F.explode(self_and_ancestors("_parent")).alias("_gone"))
              .join(gone, "_gone", "left_semi").select("_parent").distinct())
    kept = rows.join(inside, "_parent", "left_anti").drop("_parent")
    return kept.join(gone.withColumnRenamed("_gone", "path"), "path", "left_anti")
