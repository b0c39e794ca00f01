"""URL filters (operator 10), with DataFrame functions only: a path-template tree per host.

1. A path's segments lose their variable parts: runs of digits and long hexadecimal strings become
   ``<n>`` and ``<x>``. The tree has the full depth of the paths.
2. Templates that differ in one level's segment only are branches of one group; ``LEAST_BRANCHES``
   or more say that the level may be variable. Every (host, depth) generalises the level with the
   largest group first, the deeper of equals, and goes on with the others until none has a group.
   Labelled branches, rare or not, merge into the wildcard ``<*>`` where their share of bad labels
   agrees with that of all labelled branches within two standard errors and lies on the same side
   of one half; the others stay literal.
3. Branches without labels follow the evidence of the group. At least ``LEAST_BRANCHES`` labelled
   branches, none of which lies on the other side of one half, say that the segment is a variable:
   the unlabelled ones merge with them. So eight bad ``/<word>/buy-now`` judge a ninth, while a
   blocked ``/de/`` alone says nothing about ``/es/``. Where no branch has labels, all merge into
   ``<*>``; else those with less than ``MIN_SHARE`` of their host's pages go into a wildcard of
   their own, ``<?>``.
4. A template is rejected when it has bad labels of its own and its smoothed share of good labels
   is below ``LEAST_PURITY``. It is smoothed towards its host's share, worth ``PRIOR`` pages, and
   the host's towards the mean of all hosts with labels, where each host weighs the same. A template
   without labels has its host's share as purity and is always allowed.

Explicit rules come first. Pages that a rule decides are the labelled ones unless the caller
brings labels.

Spark plan: pages are counted by (host, shape) before anything else, with map-side combine; the
tree works on those counts. A round looks for groups at all levels in one aggregate, keyed by the
MD5 of the template around the level, and generalises one level of every (host, depth) at once, so
there are as many rounds as a host has variable levels one beside the other, not as paths have
segments. Pages meet their verdict by one join on (host, shape).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakerules.llm._common import UPPER, cut, pick

MIN_SHARE = 0.01
LEAST_BRANCHES = 3
PRIOR = 10.0
LEAST_PURITY = 0.3
ANY, UNKNOWN = "<*>", "<?>"  # a path has no "?", and shape() leaves no other "<"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (``host/path``) that fits, as text; null where none does. ``rules`` holds
    (rule, verdict) pairs and is compiled to one CASE."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def shape(path: Column) -> Column:
    """The path's segments with variable parts replaced."""
    segments = F.array_remove(F.split(path, "/"), "")
    return F.transform(segments, lambda s: F.when(s.rlike(r"^[0-9a-fA-F-]{12,}$"), F.lit("<x>")).otherwise(
        F.regexp_replace(F.regexp_replace(s, "<", "&lt;"), "[0-9]+", "<n>")))


def _widest_levels(nodes: DataFrame) -> DataFrame:
    """``host, depth, level``: the open level whose largest group of branches is the largest."""
    around = F.md5(F.array_join(F.concat(
        F.slice("template", F.lit(1), F.col("level")), F.array(F.lit(ANY)),
        F.slice("template", F.col("level") + 2, F.size("template"))), "/"))
    levels = nodes.filter("depth > 0").select("host", "depth", "template", F.explode(
        F.array_except(F.sequence(F.lit(0), F.col("depth") - 1), "done")).alias("level"))
    groups = levels.select("host", "depth", "level", around.alias("around")).groupBy(
        "host", "depth", "level", "around").agg(F.count(F.lit(1)).alias("branches"))
    return groups.filter(F.col("branches") >= LEAST_BRANCHES).groupBy("host", "depth").agg(
        F.max(F.struct("branches", "level"))["level"].alias("level"))


def _hosts(paths: DataFrame) -> DataFrame:
    """``host, host_n, prior``: pages, and the share of bad labels that stands in for missing ones."""
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.sum("labelled").alias("host_l"), F.sum("bad").alias("host_b"))
    overall = hosts.filter("host_l > 0").agg(F.avg((F.col("host_b") + 1) / (F.col("host_l") + 2))).first()[0] or 0.0
    return cut(hosts.select("host", "host_n", (
        (F.col("host_b") + PRIOR * overall) / (F.col("host_l") + PRIOR)).alias("prior")))


def _merge_branches(paths: DataFrame, hosts: DataFrame) -> DataFrame:
    """Adds ``template``: the shape, widened where branches are alike."""
    paths = paths.withColumn("template", F.col("segments")).withColumn("depth", F.size("segments")).withColumn(
        "done", F.array().cast("array<int>"))
    while True:
        nodes = paths.groupBy("host", "depth", "done", "template").agg(
            F.sum("n").alias("node_n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        chosen = cut(_widest_levels(nodes))
        if chosen.isEmpty():
            return paths

        def with_segment(segment: str) -> Column:
            return F.concat(F.slice("template", F.lit(1), F.col("level")), F.array(F.lit(segment)),
                            F.slice("template", F.col("level") + 2, F.size("template")))

        stats = nodes.join(chosen, ["host", "depth"]).withColumn("wider", with_segment(ANY))
        mostly_bad = F.when(F.col("l") > 0, (2 * F.col("b") >= F.col("l")).cast("int"))
        groups = stats.groupBy("host", "wider").agg(
            F.sum("l").alias("all_l"), F.sum("b").alias("all_b"), F.count(F.lit(1)).alias("branches"),
            F.count(mostly_bad).alias("known"), F.sum(mostly_bad).alias("known_bad"))
        stats = stats.join(groups.filter(F.col("branches") >= LEAST_BRANCHES), ["host", "wider"]).join(hosts, "host")
        rate = (F.col("all_b") + PRIOR * F.col("prior")) / (F.col("all_l") + PRIOR)
        error = F.sqrt(rate * (1 - rate) / F.col("l"))
        agrees = (F.abs(F.col("b") / F.col("l") - rate) <= 2 * error) & (mostly_bad == (rate >= 0.5).cast("int"))
        one_sided = (F.col("known") >= LEAST_BRANCHES) & F.col("known_bad").isin(F.lit(0), F.col("known"))
        rare = F.col("node_n") < MIN_SHARE * F.col("host_n")
        name = (F.when((F.col("all_l") == 0) | ((F.col("l") == 0) & one_sided), F.col("wider"))
                .when(F.col("l") == 0, F.when(rare, with_segment(UNKNOWN)))
                .when(agrees, F.col("wider")))
        merged = stats.select("host", "template", name.alias("name")).filter("name is not null")
        paths = cut(paths.join(merged, ["host", "template"], "left").join(chosen, ["host", "depth"], "left").select(
            "host", "segments", "n", "labelled", "bad", "depth", F.coalesce("name", "template").alias("template"),
            F.when(F.col("level").isNull(), F.col("done")).otherwise(F.array_append("done", F.col("level"))).alias("done")))


def path_templates(pages: DataFrame) -> DataFrame:
    """``host, segments, template, pages, labelled, bad, purity, rejected`` for each distinct shape
    of ``pages``, which has ``host, segments`` and ``bad`` (1, 0 or null: not labelled)."""
    paths = cut(pages.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    hosts = _hosts(paths)
    paths = _merge_branches(paths, hosts)
    stats = paths.groupBy("host", "template").agg(
        F.sum("n").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    purity = (F.col("labelled") - F.col("bad") + PRIOR * (1 - F.col("prior"))) / (F.col("labelled") + PRIOR)
    stats = stats.join(hosts.select("host", "prior"), "host").withColumn("purity", purity).drop("prior")
    stats = stats.withColumn("rejected", (F.col("bad") > 0) & (F.col("purity") < LEAST_PURITY))
    return paths.select("host", "segments", "template").join(stats, ["host", "template"])


def judge(df: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
          label_col: str | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row.

    ``rules`` are (``host/path``, ``allow`` or ``block``). ``label_col`` (1 bad, 0 good, null
    unknown) replaces the rules' verdicts as labels.

    - A null url and one without ``://`` have empty host and path; they form a host of their own,
      which no rule fits. An empty path has the root template.
    - Rows given twice count twice; null ids are kept. An empty table gives an empty result.
    - Long paths are read whole, and every level counts. Other columns do not travel along.
    - Of fitting rules of equal length the later in text order wins. A label other than 0 and 1
      counts as unknown.
    """
    cols = {"page_id": id_col, "url": url_col} | ({"label": label_col} if label_col else {})
    rows = pick(df, **cols)
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.col("rule").isin([r for r, verdict in rules if verdict == "block"])
    label = F.when(F.col("label").isin(0, 1), F.col("label").cast("int")) if label_col else F.when(F.col("rule").isNotNull(), blocked.cast("int"))
    rows = rows.withColumn("segments", shape(F.col("path"))).withColumn("bad", label)
    templates = path_templates(rows.select("host", "segments", "bad")).select(
        F.col("host").alias("t_host"), F.col("segments").alias("t_segments"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", "rejected")
    found = rows.join(templates, (F.col("host") == F.col("t_host")) & (F.col("segments") == F.col("t_segments")), "left")
    verdict = F.when(F.col("rule").isNotNull(), F.when(blocked, "block").otherwise("allow")).otherwise(
        F.when(F.col("rejected"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
