"""Toxicity (operator 7): subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (3 to 5 bytes of ``<word>``) and of the
word itself, all hashed into one table, so a misspelling shares most vectors with the word it comes
from. A window of ``WINDOW`` words is the mean of its words, and a linear softmax over two classes
judges it. Toxic words are a small part of a document, so a document is as toxic as its worst
window; table and softmax are trained together in numpy on those windows. Windows overlap by half
and cover the whole text.

Scoring needs one number per bucket, its vector times the difference of the two softmax rows, so
tasks carry that table only. It is applied once per distinct word of a slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakerules.llm import _linear as fit
from lakerules.llm._common import crc, pick
from lakerules.llm._text import U64, Words, mix, salt, slices

PER_CLASS = 1500
BUCKETS = 1 << 16
DIMENSIONS = 16
ORDERS = (3, 4, 5)
WINDOW = 4
STEP = 2
WARM_STEPS, ROUNDS, STEPS, RATE, DECAY = 60, 20, 10, 0.05, 3e-6
SEED = "toxicity-1"
SLICE = 1 << 20


def word_buckets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a slice's distinct words: which distinct word each word is, and the buckets of each
    distinct word with the position where its buckets begin."""
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    start, end = words.start[first], words.end[first]
    size = end - start + 2
    at = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(first)), size)
    letters = np.empty(at[-1], np.uint64)
    inner = np.arange(at[-1]) - at[owner] - 1
    source = start[owner] + inner
    edge = (inner < 0) | (source >= end[owner])
    letters[~edge] = words.data[source[~edge]]
    letters[edge] = np.where(inner[edge] < 0, 60, 62)  # < and >
    owners, buckets = [np.arange(len(first))], [(mix(words.hash[first]) >> U64(48)).astype(np.int64)]
    code = letters
    for order in range(2, max(ORDERS) + 1):
        code = (code[:-1] << U64(8)) | letters[order - 1:]
        if order in ORDERS:
            inside = owner[:len(code)] == owner[order - 1:]
            buckets.append((mix(code[inside] + salt(order)) >> U64(48)).astype(np.int64))
            owners.append(owner[:len(code)][inside])
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return which, bucket[order], np.searchsorted(owner[order], np.arange(len(first) + 1))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all windows, in words. A row of n words has ceil((n - WINDOW) / STEP) + 1
    of them, the last one ending at its end; a row without words has none."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STEP)) + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum(nth * STEP + WINDOW, n[row])
    start = np.maximum(0, end - WINDOW)
    return row, first[:-1][row] + start, first[:-1][row] + end


def _means(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return (total[end] - total[start]) / np.maximum(end - start, 1)


def worst_windows(words: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: the largest window mean of ``table`` over its words, and that window's bounds."""
    n = len(words.offsets) - 1
    best, low, high = np.zeros(n), np.zeros(n, int), np.zeros(n, int)
    if len(words):
        which, bucket, at = word_buckets(words)
        each = _means(table[bucket], at[:-1], at[1:])[which]
        row, start, end = windows(words.first)
        value = _means(each, start, end)
        order = np.lexsort((-start, value, row))
        last = np.flatnonzero(np.concatenate((row[order][1:] != row[order][:-1], [True])))
        pick_ = order[last]
        best[row[pick_]], low[row[pick_]], high[row[pick_]] = value[pick_], start[pick_], end[pick_]
    return best, low, high


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", learn: Column | None = None, per_class: int = PER_CLASS,
          rounds: int = ROUNDS, steps: int = STEPS, seed: str = SEED) -> dict:
    """The model: ``table`` (a number per bucket) and the calibration ``a``, ``b``.

    ``learn`` is a condition on ``doc_id`` that learned rows must meet. Reads whole texts of at
    most ``per_class`` documents per label; every fifth one calibrates, weighted by the labels'
    shares. Training starts on whole documents; then each round finds every document's worst window
    anew and takes ``steps`` steps on those. Without both labels every text scores 0.
    """
    known = fit.label_rows(labels, id_col, label_col)
    if learn is not None:
        known = known.filter(learn)
    share = fit.class_shares(known)
    model = {"table": np.zeros(BUCKETS), "a": 1.0, "b": -35.0}
    if not (share.get(0) and share.get(1)):
        return model
    sample = fit.labelled_sample(pick(docs, doc_id=id_col, text=text_col), known, per_class, seed)
    got = sample.select(F.col("doc_id").cast("string"), "label", F.coalesce("text", F.lit("")).alias("text")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["label"] for r in got], float)
    if len(got) < 2 or y.min() == y.max():
        return model
    return fit_texts([r["text"] for r in got], y, share, rounds, steps)


def _sample_words(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Words per text, each word's distinct word, and the distinct words' buckets; slice by slice."""
    counts, hashes, seen, buckets, sizes = [], [], [], [], []
    for low, high in slices(texts, SLICE):
        words = Words(texts.slice(low, high - low))
        _, bucket, at = word_buckets(words)
        counts.append(words.counts)
        hashes.append(words.hash)
        seen.append(np.unique(words.hash))
        buckets.append(bucket.astype(np.int32))
        sizes.append(np.diff(at))
    keys, first = np.unique(np.concatenate(seen), return_index=True)
    size, bucket = np.concatenate(sizes), np.concatenate(buckets)
    begin, size = (np.cumsum(size) - size)[first], size[first]
    at = np.concatenate(([0], np.cumsum(size)))
    bucket = bucket[np.arange(at[-1]) + np.repeat(begin - at[:-1], size)]
    which = np.concatenate([np.searchsorted(keys, h).astype(np.int32) for h in hashes])
    return np.concatenate(counts), which, bucket, at


def fit_texts(texts: list[str], y: np.ndarray, share: dict, rounds: int = ROUNDS, steps: int = STEPS) -> dict:
    """The model of these texts and labels; ``share`` has the true number of each label."""
    counts, which, bucket, at = _sample_words(pa.array(texts, pa.large_string()))
    row, start, end = windows(np.concatenate(([0], np.cumsum(counts))))
    rng = np.random.default_rng(11)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    softmax = rng.normal(0, 0.1, (2, DIMENSIONS))
    bias = np.zeros(2)
    fold = np.arange(len(texts)) % 5
    kept = (fold != 4) & (counts > 0)
    each = np.where(y == 1, 0.5 / max(1, y[kept].sum()), 0.5 / max(1, (1 - y[kept]).sum())) * kept
    size = np.diff(at)

    def table() -> np.ndarray:
        return vectors @ (softmax[1] - softmax[0])

    def word_values(t: np.ndarray) -> np.ndarray:
        return _means(t[bucket], at[:-1], at[1:])[which]

    def worst(values: np.ndarray) -> np.ndarray:
        mean = _means(values, start, end)
        order = np.lexsort((-start, mean, row))
        return order[np.flatnonzero(np.concatenate((row[order][1:] != row[order][:-1], [True])))]

    # First whole documents as one window each, then every document's worst window.
    docs = np.flatnonzero(kept)
    spans = (docs, (np.cumsum(counts) - counts)[docs], np.cumsum(counts)[docs])
    for turn in range(rounds + 1):
        if turn:
            chosen = worst(word_values(table()))
            chosen = chosen[kept[row[chosen]]]
            spans = row[chosen], start[chosen], end[chosen]
        doc, low, high = spans
        length = high - low
        token = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(low, length)
        window = np.repeat(np.arange(len(doc), dtype=np.int32), length)
        # Only the words of these windows, with their buckets, take part in the steps.
        used, word = np.unique(which[token], return_inverse=True)
        owner = np.repeat(np.arange(len(used), dtype=np.int32), size[used])
        first = np.concatenate(([0], np.cumsum(size[used])))
        own = bucket[np.arange(first[-1]) - first[owner] + at[used][owner]]
        scale = 1.0 / size[used]

        def gradients(_):
            by_own = np.bincount(owner, weights=table()[own], minlength=len(used)) * scale
            logit = np.bincount(window, weights=by_own[word], minlength=len(doc)) / length + bias[1] - bias[0]
            error = each[doc] * (fit.sigmoid(logit) - y[doc])
            by_word = np.bincount(word, weights=(error / length)[window], minlength=len(used))
            pull = np.bincount(own, weights=(by_word * scale)[owner], minlength=BUCKETS)
            toward = pull @ vectors
            return [pull[:, None] * (softmax[1] - softmax[0])[None] + DECAY * vectors,
                    np.stack([-toward, toward]), np.array([-error.sum(), error.sum()])]

        fit.adam([vectors, softmax, bias], gradients, steps if turn else WARM_STEPS, RATE)
    values = word_values(table())
    best = np.zeros(len(texts))
    chosen = worst(values)
    best[row[chosen]] = _means(values, start, end)[chosen]
    held = fold == 4
    if len(set(y[held])) < 2:
        held[:] = True
    real = np.where(y == 1, share[1] / max(1, y[held].sum()), share[0] / max(1, (1 - y[held]).sum()))[held]
    a, b = fit.calibrate(best[held], y[held], real * held.sum() / real.sum())
    return {"table": table(), "a": a, "b": b}


def scorer(model: dict):
    """A column function: text -> probability of label 1."""
    table, a, b = model["table"].astype(np.float32), model["a"], model["b"]

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [np.zeros(0)]
        for low, high in slices(texts, SLICE):
            words = Words(texts.slice(low, high - low))
            best, _, _ = worst_windows(words, table)
            parts.append(fit.sigmoid(np.where(words.counts > 0, a * best + b, -35.0)))
        return pa.array(np.concatenate(parts), pa.float64())

    return score


def judge(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row; only the text is looked at.

    - A null text, and one without words, scores (nearly) 0.
    - Whole texts are read, in windows; a tie between windows does not change the score.
    - Rows given twice score alike; null ids are kept; an empty table gives an empty result; other
      columns are not read.
    """
    rows = pick(df, doc_id=id_col, text=text_col).select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return rows.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    return crc(doc_id) % 5 == 0
