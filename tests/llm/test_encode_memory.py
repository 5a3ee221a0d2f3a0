"""Memory of the encoder, and that results don't follow what a worker's cache holds."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import mergedropout
from weftline.llm._text import raw

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return mergedropout.Vocabulary(MODEL)


def test_the_arrays_of_a_batch_are_small(vocabulary, monkeypatch):
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdeilmnorstu", k=draw.randint(2, 9))) for _ in range(60_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([" ".join(draw.choices(words, k=600)) for _ in range(400)])], ["doc_id", "text"]) for _ in range(2)]
    monkeypatch.setitem(mergedropout._held, "traced", vocabulary)
    monkeypatch.setitem(mergedropout._caches, "traced", mergedropout.Cache())
    tracemalloc.start()
    try:
        assert all(all(out.column("lossless").to_pylist()) for out in mergedropout._encode("traced", 0, 0.1)(iter(batches)))
        assert tracemalloc.get_traced_memory()[1] < 80e6  # 1.5 MB of text a batch; 183 MB with whole batches and copied caches
    finally:
        tracemalloc.stop()


def test_full_caches_and_longest_words_change_no_token(vocabulary):
    draw = random.Random(6)
    texts = [" ".join("".join(draw.choices("aehnorst", k=draw.choice([1, 4, 7, n]))) for _ in range(40)) for n in (62, 63, 64, 65, 66, 200) for _ in range(5)]
    data, offsets = raw(pa.array(texts))
    ids = np.arange(len(texts))
    want, marks = mergedropout.encode_texts(vocabulary, data, offsets, ids)
    for most in (0, 1, 50, 300, 400_000):
        cache = mergedropout.Cache(most)
        for _ in range(2):
            for i in range(len(texts)):
                tokens, _ = mergedropout.encode_texts(vocabulary, data[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i], ids[i : i + 1], cache=cache)
                assert tokens.tolist() == want[marks[i] : marks[i + 1]].tolist()
        assert len(cache.keys) <= most
