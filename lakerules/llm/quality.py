"""Quality rules (operator 5): fixed rules on counts, then a calibrated classifier.

The classifier is a logistic regression over hashed word n-grams (1 and 2 words) and character
n-grams (2 to 4 bytes), trained in numpy on at most ``PER_CLASS`` labelled documents per label and
Platt-calibrated on a fold of them that training does not see, with the labels' true shares as
weights. Scoring runs in Arrow batches. A text's score is the mean weight of its grams, so a batch
is scored by gathers and sums; batches are cut into slices of ``SLICE`` bytes, which bounds memory
for any batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakerules.llm import _linear as fit
from lakerules.llm._common import pick
from lakerules.llm._exchange import expand, squeeze
from lakerules.llm._text import U64, Words, mix, release, salt, shingles, slices

PER_CLASS = 1000
BUCKETS = 1 << 18
CHAR_ORDERS = (2, 3, 4)
WORD_ORDERS = (1, 2)
KEEP_FROM = 0.5
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of words
WINDOW = 8
SLICE = 1 << 20
FIT_GRAMS = 1 << 16  # grams that a step of the training looks at together
SEED = "quality-1"
BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = "struct<" + ",".join(f"{x}:bigint" for x in BASE_FIELDS) + ",probability:double>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_GAP_OR_TAIL = np.zeros(256, bool)  # white space, or a UTF-8 byte after a character's first
_GAP_OR_TAIL[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether its row has it elsewhere, and whether it had it before."""
    order = np.lexsort((values, rows))  # stable, so equal values stay in text order
    v, r = values[order], rows[order]
    same = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    earlier = np.concatenate(([False], same))
    any_, before = np.empty(len(v), bool), np.empty(len(v), bool)
    any_[order] = earlier | np.concatenate((same, [False]))
    before[order] = earlier
    return any_, before


def base_counts(words: Words) -> dict[str, np.ndarray]:
    n, rows = len(words.offsets) - 1, np.arange(len(words.offsets) - 1)
    data, offsets = words.data, words.offsets
    # Lines: cut at \n and at the texts' ends; only lines with a word count.
    row_of = np.repeat(rows, np.diff(offsets))
    breaks = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate((offsets, breaks, breaks + 1)))
    low, high = bounds[:-1], bounds[1:]
    with_word = np.searchsorted(words.start, high) > np.searchsorted(words.start, low)
    low, high = low[with_word], high[with_word]
    line = words.hash_of(low, high)
    _, before = _again(line, row_of[low] if len(low) else low)
    dup_lines = np.bincount(row_of[low][before], minlength=n) if len(low) else np.zeros(n, int)
    windows, doc = shingles(words, WINDOW)
    repeated = np.zeros(n, int)
    if len(windows):
        at = np.flatnonzero(words.doc[:len(words) - WINDOW + 1] == words.doc[WINDOW - 1:])
        twice, _ = _again(windows, doc)
        marks = np.zeros(len(words) + 1, int)
        marks[at[twice]] += 1
        marks[at[twice] + WINDOW] -= 1
        repeated = np.bincount(words.doc[np.cumsum(marks[:-1]) > 0], minlength=n)
    return {"n_words": words.counts, "word_chars": _per_row(~_GAP_OR_TAIL[data], offsets),
            "n_symbols": _per_row(_IS_SYMBOL[data], offsets), "n_dup_lines": dup_lines,
            "n_repeat_words": repeated}


def grams(words: Words):
    """(row, bucket) arrays, one pair per n-gram order; characters first."""
    data, offsets = words.data, words.offsets
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    code = data.astype(np.uint32)
    for order in range(2, max(CHAR_ORDERS) + 1):
        code = (code[:-1] << np.uint32(8)) | data[order - 1:]
        if order in CHAR_ORDERS:
            bucket = ((code ^ np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(14)
            inside = row[:len(code)] == row[order - 1:]
            yield row[:len(code)][inside], bucket[inside].astype(np.int32)
    for order in WORD_ORDERS:
        h, doc = shingles(words, order) if order > 1 else (words.hash, words.doc)
        yield doc, (mix(h ^ salt(order)) >> U64(46)).astype(np.int32)


def _mean_weights(words: Words, weights: np.ndarray) -> np.ndarray:
    n = len(words.offsets) - 1
    total = np.zeros(n)
    for row, bucket in grams(words):
        count = np.bincount(row, minlength=n)
        total += np.bincount(row, weights=weights[bucket], minlength=n) / np.maximum(count, 1)
    return total


def _features(batches):
    for batch in batches:
        texts = batch.column("text")
        for low, high in slices(texts, SLICE):
            words = Words(texts.slice(low, high - low), lower=False)
            n = high - low
            parts = []
            for row, bucket in grams(words):
                key, count = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
                rows = key // BUCKETS
                parts.append((rows, key % BUCKETS, count / np.bincount(row, minlength=n)[rows]))
            rows, buckets, values = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(rows, kind="stable")
            bounds = np.searchsorted(rows[order], np.arange(n + 1))
            pieces = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(low, n).cast(pa.string()), batch.column("label").slice(low, n).cast(pa.int32()),
                pa.array([len(p) for p in pieces], pa.int64()),
                pa.array([squeeze(np.diff(buckets[p].astype(np.int32), prepend=np.int32(0))) for p in pieces], pa.binary()),
                pa.array([squeeze(values[p].astype(np.float32)) for p in pieces], pa.binary())],
                names=["doc_id", "label", "size", "buckets", "values"])
        release()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_class: int = PER_CLASS, steps: int = 120, seed: str = SEED) -> dict:
    """The model: ``weights`` per bucket and the calibration ``a``, ``b``.

    Reads at most ``per_class`` labelled documents per label (1 good, 0 bad), whole. Every fourth
    of them calibrates. Without both labels the model keeps every text.
    """
    known = fit.label_rows(labels, id_col, label_col)
    share = fit.class_shares(known)
    model = {"weights": np.zeros(BUCKETS), "a": 1.0, "b": 0.0}
    if not (share.get(0) and share.get(1)):
        return model
    sample = fit.labelled_sample(pick(docs, doc_id=id_col, text=text_col), known, per_class, seed)
    rows = sample.mapInArrow(_features, "doc_id string, label int, size long, buckets binary, values binary").collect()
    rows.sort(key=lambda r: (r["label"], r["doc_id"]))
    y = np.array([r["label"] for r in rows], float)
    if not rows or y.min() == y.max():
        return model
    held = np.arange(len(rows)) % 4 == 3
    n, kept = len(rows), ~held
    size = np.array([r["size"] for r in rows], np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    col, val = np.empty(at[-1], np.int32), np.empty(at[-1], np.float32)
    for i in range(n):  # each row is dropped once it is unpacked
        col[at[i]:at[i + 1]] = np.cumsum(expand(rows[i]["buckets"], np.int32), dtype=np.int32)
        val[at[i]:at[i + 1]] = expand(rows[i]["values"], np.float32)
        rows[i] = None
    each = np.where(y == 1, 0.5 / max(1, (y[kept] == 1).sum()), 0.5 / max(1, (y[kept] == 0).sum())) * kept
    weights, bias = np.zeros(BUCKETS), np.zeros(1)
    bounds = [0]  # row ranges of at most FIT_GRAMS grams, or one row
    while bounds[-1] < n:
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(at, at[bounds[-1]] + FIT_GRAMS, "right")) - 1))

    def chunks():
        """Row ranges, and the row, bucket and value of each of their grams."""
        for low, high in zip(bounds[:-1], bounds[1:]):
            a, b = at[low], at[high]
            yield low, high, np.repeat(np.arange(low, high), size[low:high]), col[a:b].astype(np.intp), val[a:b]

    def margins():
        return np.concatenate([np.bincount(r_ - low, weights=v_ * weights[c_], minlength=high - low)
                               for low, high, r_, c_, v_ in chunks()])

    def gradients(_):
        error = each * (fit.sigmoid(margins() + bias[0]) - y)
        total = np.zeros(BUCKETS)
        for _, _, r_, c_, v_ in chunks():
            np.add.at(total, c_, v_ * error[r_])
        return total + 1e-7 * weights, np.array([error.sum()])

    fit.adam([weights, bias], gradients, steps, 0.3)
    score = margins()
    held = held if held.any() and len(set(y[held])) == 2 else np.ones(n, bool)
    real = np.where(y == 1, share[1] / (y[held] == 1).sum(), share[0] / (y[held] == 0).sum()) if held.any() else y
    real = real[held] * held.sum() / real[held].sum()
    model["a"], model["b"] = fit.calibrate(score[held], y[held], real)
    model["weights"] = weights
    return model


def scorer(model: dict):
    """A column function: text -> struct of the base counts and the probability of label 1."""
    weights, a, b = model["weights"].astype(np.float32), model["a"], model["b"]

    @F.arrow_udf(FIELDS)
    def score(texts: pa.Array) -> pa.Array:
        parts: dict[str, list] = {x: [] for x in (*BASE_FIELDS, "probability")}
        for low, high in slices(texts, SLICE):
            words = Words(texts.slice(low, high - low), lower=False)
            for name, values in base_counts(words).items():
                parts[name].append(values)
            parts["probability"].append(fit.sigmoid(a * _mean_weights(words, weights) + b))
        arrays = [pa.array(np.concatenate(v) if v else np.zeros(0), pa.float64() if k == "probability" else pa.int64())
                  for k, v in parts.items()]
        release()
        return pa.StructArray.from_arrays(arrays, names=list(parts))

    return score


def rejected_by_base(q: Column) -> Column:
    return (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])


def kept(q: Column) -> Column:
    return ~rejected_by_base(q) & (q["probability"] >= KEEP_FROM)


def judge(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``probability`` for every row.

    - A null or empty text has no words: all counts 0, ``base_failed`` true, ``kept`` false.
    - Texts are read whole. Rows given twice are judged twice, alike; null ids are kept.
    - An empty table gives an empty result; other columns are not read.
    """
    rows = pick(df, doc_id=id_col, text=text_col).select("doc_id", scorer(model)(F.col("text")).alias("q"))
    q = F.col("q")
    return rows.select("doc_id", *[q[x].alias(x) for x in BASE_FIELDS],
                       rejected_by_base(q).alias("base_failed"), kept(q).alias("kept"),
                       q["probability"].alias("probability"))


def keep_good(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    judged = plain.withColumn("q", scorer(model)(F.col(f"c{names.index(text_col)}")))
    return judged.filter(kept(F.col("q"))).drop("q").toDF(*names)
