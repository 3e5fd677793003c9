"""What training holds in the driver: word inputs of some windows, not of all words of the sample."""

from __future__ import annotations

import tracemalloc

import numpy as np

from tallyspark.llm import toxicity


def test_windows_are_scored_without_the_inputs_of_all_words():
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [" ".join("".join(w) for w in rng.choice(letters, (300, 12))).encode() for _ in range(1000)] + [b"", b"one two"]
    words, net = toxicity.Words(texts), toxicity.Network()
    net.window_logits(toxicity.Words([b"warm up"]))
    tracemalloc.start()
    logits, begin, length, of = net.window_logits(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # before: 128 MB, and 70 MB with half the words
    assert len(words.word) == 300_002 and peak < 80e6
    order = np.argsort(-length, kind="stable")
    want = np.empty_like(logits)
    want[order] = net.run(net.inputs(words), *toxicity._rows(words, begin[order], length[order]))
    assert np.allclose(logits, want, atol=1e-5) and set(of) == set(range(1002))
