"""What the driver holds and starts beside the tables."""

import itertools
import os
import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from vidmart.llm import common, quality, toxicity

WORDS = ["".join(x) for x in itertools.product("abcdefgh", repeat=3)][:400]


def examples(n, words, each):
    rng = random.Random(3)
    rows = []
    for _ in range(n):
        t = sorted({min(rng.randrange(words), rng.randrange(words), rng.randrange(words)) for _ in range(each)})
        rows.append((np.array(t), np.array([rng.randint(1, 3) for _ in t])))
    return rows


def test_whole_texts_go_to_the_tasks_as_uses(spark):
    """Weights and the matrix of common words, several times as large, are made from them there, to the same cosines."""
    rows = examples(600, 400, 60)
    whole = toxicity.WholeTexts(WORDS, np.linspace(1, 3, 400), rows)
    whole.cosines(whole.vectors[:5])
    sent = pickle.dumps(whole)
    assert len(sent) < 8 * sum(len(t) for t, _ in rows) + 16 * 400 + 10_000
    there = pickle.loads(sent)
    assert there.cosines(whole.vectors).tobytes() == whole.cosines(whole.vectors).tobytes()
    full = np.zeros((600, 400))
    for i, (t, w) in enumerate(whole.vectors):
        full[i, t] = w
    assert len(there.matrix) and len(there.rare[0]) and np.allclose(there.cosines(whole.vectors), full @ full.T)
    assert [x.tolist() for x in there.counts(f"{WORDS[3]} {WORDS[399].upper()} {WORDS[3]} other")] == [[3, 399], [2, 1]]


def test_empty_examples_have_no_cosine():
    none = np.zeros(0, int)
    whole = toxicity.WholeTexts(["a", "b"], np.ones(2), [(none, none), (np.array([1]), np.array([2]))])
    assert whole.cosines([whole.vector("b"), whole.vector("c")]).tolist() == [[0, 1], [0, 0]]
    nothing = toxicity.WholeTexts([], np.zeros(0), [])
    assert nothing.cosines([nothing.vector("b")]).shape == (1, 0)


def test_saved_tables_have_no_marker_file(spark):
    plain, dealt = common.saved(spark.range(7), "plain"), common.saved(spark.range(7), "dealt", "id")
    for out in (plain, dealt):
        assert sorted(r["id"] for r in out.collect()) == list(range(7))
        assert not [x for x in os.listdir(out.held_at.removeprefix("file:")) if "_SUCCESS" in x]
    common.release(plain, dealt)


def test_array_kernels_hold_little_at_a_time():
    """What the kernels make of a slice is up to 140 times as long; two workers of an executor hold it at once."""
    column = pa.array(["Some words, 12 of them\n" * 40] * 3000)
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    tracemalloc.start()
    n = sum(len(quality.statistics(*common.text_arrays(s.column("text")))) for s in common.slices([batch], "text"))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n == 3000 and most < 70
