"""Language identification (operator 2): error-correcting output codes.

Every language gets a codeword of bits. One binary classifier per bit, a logistic regression over
hashed byte n-grams (1 to 3) of the folded text, predicts that bit; all bits are trained together
in numpy on at most ``PER_LANGUAGE`` documents per language. Decoding sums, for each codeword, the
logistic loss of the predicted margins, weighted by how well each bit did on documents that its
training did not see. The nearest codeword wins; a small lead over the next one is ``ambiguous``.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakerules.llm import _linear as fit
from lakerules.llm._common import crc, pick
from lakerules.llm._text import LOWER, buffer_of, slices

PER_LANGUAGE = 250
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
AMBIGUOUS_BELOW = 0.2  # lead in score over the next language
UNKNOWN = "und"
SEED = "langid-1"
SLICE = 1 << 21


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` distinct rows of -1 and 1. Up to 6 classes: every split of the classes once, the
    exhaustive code. More: the best of 200 random codes by their least Hamming distance, with
    columns that all split the classes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, best_gap = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        gap = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        if gap > best_gap:
            best, best_gap = code, gap
    return best


def gram_counts(text: np.ndarray) -> np.ndarray:
    """Shares of the hashed byte n-grams of one folded text; each order sums to 1."""
    out = np.zeros(BUCKETS)
    code = np.zeros(len(text) + 1, np.uint32)
    for order in ORDERS:
        if len(text) < order:
            break
        code = (code[:len(text) - order + 1] << np.uint32(8)) | text[order - 1:]
        bucket = ((code ^ np.uint32(order << 28)) * np.uint32(0x9E3779B1)) >> np.uint32(18)
        out += np.bincount(bucket, minlength=BUCKETS) / len(code)
    return out


def _texts(texts: pa.Array):
    data, offsets = buffer_of(texts)
    data = LOWER[data]
    for low, high in zip(offsets[:-1], offsets[1:]):
        yield data[low:high]


def _features(batches):
    for batch in batches:
        counts = [gram_counts(t) for t in _texts(batch.column("text"))]
        used = [np.flatnonzero(c).astype(np.int32) for c in counts]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.string()), batch.column("label"),
            pa.array([u.tobytes() for u in used], pa.binary()),
            pa.array([c[u].astype(np.float32).tobytes() for c, u in zip(counts, used)], pa.binary())],
            names=["doc_id", "label", "buckets", "values"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          learn: Column | None = None, per_language: int = PER_LANGUAGE, steps: int = 120,
          seed: str = SEED) -> dict:
    """The model: ``languages`` (all that the learnable rows have, in code point order), ``code``,
    ``weights`` per bucket and bit, ``bias`` and ``trust`` per bit.

    ``learn`` is a condition on ``doc_id`` that rows must meet to be learned from. Reads whole
    texts of at most ``per_language`` rows per language; every fourth one sets ``trust``.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, label=lang_col)
    if learn is not None:
        rows = rows.filter(learn)
    rows = rows.filter("text is not null and label is not null")
    sample = fit.labelled_sample(rows.select("doc_id", "text"), rows.select("doc_id", "label"), per_language, seed)
    got = sample.mapInArrow(_features, "doc_id string, label string, buckets binary, values binary").collect()
    got.sort(key=lambda r: (r["label"], r["doc_id"]))
    languages = sorted({r["label"] for r in got}, key=lambda s: s.encode())
    code = codewords(len(languages))
    bits = code.shape[1]
    weights, bias, trust = np.zeros((BUCKETS, bits)), np.zeros(bits), np.ones(bits)
    if len(languages) > 1:
        x = np.zeros((len(got), BUCKETS), np.float32)
        for i, r in enumerate(got):
            x[i, np.frombuffer(r["buckets"], np.int32)] = np.frombuffer(r["values"], np.float32) * 10
        y = code[[languages.index(r["label"]) for r in got]]
        held = np.arange(len(got)) % 4 == 3
        a, target = x[~held], y[~held]

        def gradients(_):
            error = -target * fit.sigmoid(-target * (a @ weights.astype(np.float32) + bias)) / len(a)
            return a.T @ error.astype(np.float32) + 1e-5 * weights, error.sum(0)

        fit.adam([weights, bias], gradients, steps, 0.05)
        if held.any():
            right = ((x[held] @ weights + bias) * y[held] > 0).mean(0)
            right = (right * held.sum() + 1) / (held.sum() + 2)
            trust = np.maximum(np.log(right / (1 - right)), 0.1)
        weights *= 10
    return {"languages": languages, "code": code, "weights": weights, "bias": bias, "trust": trust / trust.sum()}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword of each row of margins, its score in 0..1 and its lead over the next."""
    loss = np.logaddexp(0, -margins[:, None, :] * model["code"][None])  # rows x languages x bits
    loss = (loss * model["trust"]).sum(2)
    share = np.exp(-(loss - loss.min(1, keepdims=True)))
    share /= share.sum(1, keepdims=True)
    order = np.sort(share, 1)
    lead = order[:, -1] - (order[:, -2] if share.shape[1] > 1 else 0)
    return share.argmax(1), share.max(1), lead


def predictor(model: dict):
    """A column function: text -> struct of ``lang_pred``, ``score`` and ``ambiguous``."""
    weights, bias = model["weights"].astype(np.float32), model["bias"]

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        best, score, lead = [], [], []
        for low, high in slices(texts, SLICE):
            margins = np.array([gram_counts(t) @ weights + bias for t in _texts(texts.slice(low, high - low))])
            b, s, l_ = decode(margins, model)
            best += [model["languages"][i] for i in b]
            score += s.tolist()
            lead += (l_ < AMBIGUOUS_BELOW).tolist()
        return pa.StructArray.from_arrays(
            [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(lead, pa.bool_())],
            names=["lang_pred", "score", "ambiguous"])

    return predict


def identify(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row; only the text is looked at.

    - Null texts and texts without a letter (empty ones too) are ``und``, score 0, ambiguous.
    - With no language learned, all rows are ``und``.
    - Whole texts are read; rows given twice get the same answer; null ids are kept; an empty table
      gives an empty result; other columns are not read.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    if not model["languages"]:
        answer = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    else:
        answer = predictor(model)(F.col("text"))
    rows = rows.select("doc_id", lettered, answer.alias("a"))
    return rows.select(
        "doc_id", F.when(F.col("lettered"), F.col("a.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("a.score")).otherwise(0.0).alias("score"),
        F.when(F.col("lettered"), F.col("a.ambiguous")).otherwise(True).alias("ambiguous"))


def held_out(doc_id: Column) -> Column:
    return crc(doc_id) % 4 == 2
