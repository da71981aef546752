"""Context trees keep every context, however many languages and byte values there are."""

import math
from collections import Counter

import numpy as np
import pytest

from wardflow.llm import language_id


def test_no_context_is_dropped(spark):
    rng = np.random.default_rng(11)
    alphabet = [chr(c) for c in range(0x100, 0x500)]
    train = []
    for x in range(20):
        letters = rng.choice(alphabet, 40)
        train += [(f"l{x:02}", "".join(rng.choice(letters, 300))) for _ in range(3)]
    model = language_id.fit(spark.createDataFrame(train, "lang string, text string"))
    seen, order = {}, language_id.ORDER
    for lang, text in train:
        full = b"\n" * order + text.encode()
        for i in range(order, len(full)):
            for k in range(order + 1):
                seen.setdefault((lang, full[i - k:i]), Counter())[full[i]] += 1

    def prob(lang, context, byte):
        below = (lambda b: prob(lang, context[1:], b)) if context else (lambda b: 1 / 256)
        if (lang, context) not in seen:
            return below(byte)
        counts = seen[lang, context]
        total = sum(counts.values()) + len(counts)
        if byte in counts:
            return counts[byte] / total
        return len(counts) / total * below(byte) / (1 - sum(below(b) for b in counts))

    texts = [train[0][1][:60].encode(), b"", train[31][1][10:70].encode() + b"!", (train[0][1][:30] + train[59][1][:30]).encode()]
    got = model.code_lengths(texts)
    assert model.contexts == Counter(lang for lang, _ in seen)
    for t, text in enumerate(texts):
        full = b"\n" * order + text
        for x in (0, 10, 19):
            want = -sum(math.log2(prob(model.labels[x], full[j - order:j], full[j])) for j in range(order, len(full)))
            assert got[t, x] == pytest.approx(want, rel=1e-4)


def test_pieces_and_single_texts_have_the_same_lengths(spark, monkeypatch):
    rows = spark.createDataFrame([("x", "abracadabra " * 40), ("y", "zebra quagga")], "lang string, text string")
    model = language_id.fit(rows)
    texts = [b"", b"zebra cadabra" * 50, b"", b"a", b"quagga"]
    whole = model.code_lengths(texts)
    monkeypatch.setattr("wardflow.llm.context_model.PIECE", 7)
    assert np.allclose(model.code_lengths(texts), whole)
    assert np.allclose([model.code_lengths([t])[0] for t in texts], whole)
