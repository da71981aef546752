"""The language stage's usual code length comes from every row, whatever the ids, and from trees that haven't learned it."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from wardflow.llm import language_id

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "")]


def good(rng, n, words=60):
    return [" ".join(rng.choice(WORDS, words)) for _ in range(n)]


def noise(rng, n):
    return ["".join(chr(c) for c in rng.integers(33, 127, 400)) for _ in range(n)]


def test_ids_do_not_move_the_threshold(spark):
    """All noise has ids of one crc32 fold of five, and no clean text has: that fold's median is noise."""
    rng = np.random.default_rng(5)
    held = iter([i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 0])
    rest = iter([i for i in range(4000) if zlib.crc32(str(i).encode()) % 5])
    clean = [(next(rest), t, "xx") for t in good(rng, 300)]
    docs = spark.createDataFrame([*clean, *[(next(held), t, None) for t in noise(rng, 20)]],
                                 "doc_id long, text string, lang string")
    whole, crossed = language_id.fit_crossed(docs)
    for kept in (language_id.keep_identified(docs, whole), language_id.keep_identified(docs, whole, crossed),
                 corpus_pipeline.identify_language(spark, docs, "")):
        assert {r.doc_id for r in kept.collect()} == {i for i, *_ in clean}


def test_unlearned_clean_texts_stay(spark):
    """Few learned rows: their own trees code them far shorter than any new text of the same language."""
    rng = np.random.default_rng(6)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 1500)]
    texts = ["".join(rng.choice(letters, 200)) for _ in range(40)]
    learned = sorted(range(40), key=lambda i: zlib.crc32(str(i).encode()) % 5)[:20]  # the rows that gave the median before
    docs = spark.createDataFrame([(i, t, "xx" if i in learned else None) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string")
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 40


def test_crossed_trees(spark):
    """The whole trees are those of ``fit``; each fold's are those of the other rows, copies of its texts left out."""
    rng = np.random.default_rng(7)
    texts = good(rng, 40, 12)
    docs = spark.createDataFrame([(t, lang) for t in texts for lang in ("a:b", "c", None)][:-20] + [(None, "c"), ("", "c")],
                                 "text string, lang string")
    docs = docs.unionByName(docs)
    whole, crossed = language_id.fit_crossed(docs)
    fold = language_id.fold_of()
    assert docs.groupBy("text").agg(F.count_distinct(fold).alias("n")).where("n <> 1").count() == 0
    for got, rows in ((whole, docs), (crossed[0], docs.where(fold == 1)), (crossed[1], docs.where(fold == 0))):
        want = language_id.fit(rows)
        assert got.labels == want.labels == ["a:b", "c"]
        for a, b in zip(got.tables, want.tables, strict=True):
            assert all(np.array_equal(x, y) for s, t in zip(a, b, strict=True) for x, y in zip(s, t, strict=True))


def test_usual_length_is_the_median_of_all_rows(spark):
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate([*good(rng, 41), "", "12"])] + [(None, None, "xx")],
                                 "doc_id long, text string, lang string")
    whole, crossed = language_id.fit_crossed(docs)
    rows = docs.withColumn("fold", language_id.fold_of())
    bits = [r.bits_per_byte for i in (0, 1)
            for r in language_id.identify(rows.where(F.col("fold") == i), crossed[i]).collect() if r.bits_per_byte is not None]
    assert len(bits) == 41
    assert abs(language_id.usual_length(docs, crossed) - np.median(bits)) < 0.001
