"""Memory and time of single operators, on rows made here."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from lakerules.llm import pieces, quality
from lakerules.llm._text import U64, mix


def random_texts(seed, n, words):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(4000)]
    return [" ".join(rng.choices(vocabulary, k=words)) for _ in range(n)]


def test_quality_training_holds_the_grams_of_its_sample_once(spark):
    texts = [*random_texts(1, 120, 1500), "", "a"]  # texts without grams are labelled too
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    tracemalloc.start()
    model = quality.train(docs, labels, steps=2)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (model["weights"] != 0).any()
    assert peak < 60 << 20, peak >> 20


def test_sampling_keeps_values_of_the_first_pieces_only():
    vocab = pieces.vocabulary()
    lattices = pieces.Lattices(pa.array(random_texts(2, 1, 3000)), vocab)
    searches, _ = pieces.sample_paths(lattices, 1, mix(np.arange(1, dtype=np.uint64)), 2)
    for (path, _, _), beside in zip(searches[0].paths, searches[0].beside):
        assert len(path) > 3000 and len(beside) < 1000, (len(path), len(beside))


def test_pieces_are_found_also_where_hashes_begin_alike():
    vocab = pieces.vocabulary()
    slots = vocab.hashes >> U64(43)
    assert vocab.most > 1 and vocab.most == np.unique(slots, return_counts=True)[1].max()
    wanted = np.concatenate((vocab.hashes, vocab.hashes ^ U64(1), mix(np.arange(100000, dtype=np.uint64))))
    hit, ids, _ = vocab.find(wanted)
    known = dict(zip(vocab.hashes.tolist(), vocab.ids.tolist()))
    assert dict(zip(hit.tolist(), ids.tolist())) == {i: known[h] for i, h in enumerate(wanted.tolist()) if h in known}
