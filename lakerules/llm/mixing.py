"""Mixing sources to target weights (operator 1): Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / quality weight, with u fixed by seed and id, so
the smallest keys of a source are a weighted sample without replacement. A source's target is
spent on complete epochs first; what is left over is filled with documents in key order until
the token budget is reached, by a prefix sum of sizes. The document that crosses the budget is
taken in part.

Spark plan. One scan makes a narrow table (id, source, size, key, slot), written once. ``slot`` is
a monotone function of the key, so the prefix sum has two levels: sums by (source, slot), combined
on the map side, and a running sum inside each (source, slot). A source with a third of all rows
is therefore spread over ``SLOTS`` groups; no task sees a source whole. Only the table of sources
is windowed in one task: it has one row per distinct source, already aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakerules.llm._common import WORD_GAPS, cut, n_words, pick, uniform

SLOTS = 1024
CYCLE = (3.0, 1.0, 2.0)
QUALITY_WEIGHT = {1: 2.0, 0: 0.5}
SEED = "mix-1"


def by_code_point() -> W:
    """Spark compares strings by their UTF-8 bytes, which is code point order."""
    return W.orderBy(F.col("source").asc_nulls_last())


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Adds ``weight``: the cycle's values, repeating, over sources by code point, null last."""
    nth = (F.row_number().over(by_code_point()) - 1) % len(cycle)
    weight = F.lit(cycle[-1])
    for i, value in enumerate(cycle[:-1]):
        weight = F.when(nth == i, F.lit(value)).otherwise(weight)
    return sources.withColumn("weight", weight.cast("double"))


def share_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes dealt by ``weight``, at most ``most`` times the
    source's own size, the excess dealt again by weight until no target is above its limit.

    In closed form: with sources ordered by limit / weight, the first that does not reach its
    limit fixes the level of all that follow.
    """
    ordered = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    rest = ordered.rowsBetween(0, W.unboundedFollowing)
    t = sources.withColumn("limit", most * F.col("source_size"))
    t = t.withColumn("total", F.sum("source_size").over(everyone) * F.lit(share))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                     / F.sum("weight").over(rest))
    free = F.when(F.col("level") * F.col("weight") < F.col("limit"), F.col("level"))
    t = t.withColumn("level", F.first(free, ignorenulls=True).over(everyone))
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return t.withColumn("target", target).drop("limit", "total", "level")


def quality_weights(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``doc_id, weight`` of labelled documents: the best label of an id decides."""
    rows = pick(labels, doc_id=id_col, label=label_col).filter("doc_id is not null and label is not null")
    best = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    weight = F.when(F.col("label") >= 1, QUALITY_WEIGHT[1]).otherwise(QUALITY_WEIGHT[0])
    return best.select("doc_id", weight.alias("weight"))


def mix(df: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", size: Column | None = None, share: float = 1.5, most: float = 2.0,
        cycle: tuple[float, ...] = CYCLE, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, epochs, taken, es_key`` per input row.

    ``taken`` counts words, repeats included: ``epochs * size`` and, for documents in the
    fractional selection, their words up to the budget. A source's sum of ``taken`` is its target
    rounded to a whole number. ``weights`` (``doc_id, weight``) gives quality weights above 0;
    documents without one weigh 1.

    - A null or empty text has size 0 and nothing of it is taken.
    - Null sources form one source, ordered last. Null ids draw one common key.
    - Equal keys are ordered by id and size. Rows given twice are two documents.
    - A source without words has target 0; an empty table gives an empty result.
    """
    rows = pick(df, doc_id=id_col, source=source_col, text=text_col)
    rows = rows.select("doc_id", "source", (n_words(F.col("text")) if size is None else size).alias("size"))
    if weights is not None:
        rows = rows.join(weights, "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    key = -F.log(uniform(seed, F.col("doc_id"))) / F.coalesce("weight", F.lit(1.0))
    rows = rows.select("doc_id", "source", "size", key.alias("es_key"))
    slot = F.least(F.lit(SLOTS - 1), F.floor((1 - F.exp(-F.col("es_key"))) * SLOTS)).cast("int")
    rows = cut(rows.withColumn("slot", slot))

    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    sources = slots.groupBy("source").agg(F.sum("slot_size").alias("source_size"))
    sources = share_targets(cycled_weights(sources, cycle), share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5)
    sources = (sources.withColumn("epochs", epochs.cast("long")).withColumn("budget", budget.cast("long"))
               .select("source", "source_size", "target", "epochs", "budget"))
    upto = W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_size").over(upto), F.lit(0)))
    slots = slots.join(sources, slots["source"].eqNullSafe(sources["source"])).select(
        slots["source"].alias("s"), F.col("slot").alias("n"), "before", "source_size", "target",
        "epochs", "budget")

    found = rows.join(slots, rows["source"].eqNullSafe(F.col("s")) & (rows["slot"] == F.col("n")))
    inside = W.partitionBy("source", "slot").orderBy("es_key", "doc_id", "size")
    left = (F.col("budget") - F.col("before")
            - F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) + F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return found.select(
        "doc_id", "source", "size", "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "es_key")


def repeat_documents(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", whole_only: bool = False) -> DataFrame:
    """The mixed corpus: ``docs``' columns, a document once for each time the mix takes it.

    ``taken`` is the result of ``mix``. When the budget ends inside a document, its last copy holds
    the words taken, joined by single spaces; with ``whole_only`` that copy is whole or left out,
    whichever comes nearer the target (whole if both are as near). Documents without words do not appear. Rows that
    share id and size appear equally often, by the largest number taken.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    plan = (taken.filter("taken > 0").groupBy("doc_id", "size").agg(F.max("taken").alias("taken")))
    inner = inner.withColumn("words", n_words(text))
    rows = inner.join(plan, doc_id.eqNullSafe(plan["doc_id"]) & (F.col("words") == F.col("size")))
    parts = F.col("taken") / F.col("size")
    rows = rows.withColumn("copies", (F.floor(parts + 0.5) if whole_only else F.ceil(parts)).cast("int")).filter("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    if whole_only:
        return rows.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
    left = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    head = F.array_join(F.slice(F.array_remove(F.split(text, WORD_GAPS), ""), F.lit(1), left), " ")
    whole = F.when(left >= F.col("size"), text).otherwise(head)
    return rows.select(*[(whole if i == names.index(text_col) else F.col(f"c{i}")).alias(name)
                         for i, name in enumerate(names)])
