"""Language identification by prediction by partial matching.

Each language gets a variable-order byte context tree with escape
probabilities (method C, with exclusion), counted over all training texts.
Statistics are then frozen: a text's exact code length under a language is
the sum of its bytes' code lengths, and the language that codes it shortest
wins.

Defined cases: a null text or one without a letter is ``und`` with score 0;
equal code lengths go to the first language by name; without training rows
every text is ``und``.  Rows with a null language or text teach nothing;
repeated rows count each time.  Very long texts are scored whole, in pieces.
Columns of the input that an output column names are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import crc_bucket, cut, give_back, map_arrow, prepare
from wardflow.llm.context_model import Automaton, context_counts, count_grams, crossed_counts, escape_rows

UNKNOWN = "und"
#: Longest context in bytes.
ORDER = 4
FOLDS = 5
#: A kept text's code length: at most this many times the usual bits a byte, and so many bits more.
LIMIT, SLACK_BITS = 2.0, 128.0

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def fit(train: DataFrame, order: int = ORDER) -> Automaton:
    """The context trees of ``train`` (columns text, lang), with every context of every row."""
    prepare(train.sparkSession)
    grams = count_grams(train, "lang", "text", order)
    return Automaton(context_counts(grams, order), order, escape_rows)


def has_letter(data: bytes) -> bool:
    if _ASCII_LETTER.search(data):
        return True
    return any(map(str.isalpha, data.decode("utf-8", "replace")))


def identify(docs: DataFrame, model: Automaton | Broadcast, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score (posterior of lang_pred) and bits_per_byte of the winner; ``model`` may be broadcast already."""
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    add = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("bits_per_byte", T.DoubleType())])

    def make():
        trees = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            data = [t or b"" for t in texts.to_pylist()]
            bits = trees.code_lengths(data)
            if not trees.labels:
                n = len(data)
                return [pa.array([UNKNOWN] * n), pa.array([0.0] * n), pa.array([None] * n, pa.float64())]
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(data)), best]
            score = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            known = [has_letter(d) for d in data]
            return [
                pa.array([trees.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]),
                pa.array([float(s) if k else 0.0 for s, k in zip(score, known, strict=True)]),
                pa.array([float(b) / len(d) if k else None
                          for b, d, k in zip(least, data, known, strict=True)], pa.float64()),
            ]

        return work

    return map_arrow(docs, {text: "binary"}, add, make, keep)


def training_rows(docs: DataFrame, folds: int = FOLDS) -> Column:
    """Rows that teach: crc32(doc_id as text) mod ``folds`` is not 0 (a null id teaches)."""
    return ~F.coalesce(crc_bucket("doc_id", folds) == 0, F.lit(False))


def fold_of(text: str = "text", folds: int = 2) -> Column:
    """A fold by the text itself, so that its copies lie in the same one; 0 for a null."""
    return F.when(F.col(text).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(text)), F.lit(folds)))


def fit_crossed(train: DataFrame, order: int = ORDER) -> tuple[Automaton, list[Automaton]]:
    """The context trees of all of ``train``, and for each fold those of its other rows, from one count."""
    prepare(train.sparkSession)
    rows = train.select("lang", "text", (fold_of() == 1).alias("part"))
    # the driver holds one set of counts at a time
    whole, *others = [Automaton(x, order, escape_rows)
                      for x in crossed_counts(count_grams(rows, "lang", "text", order, "part"), order)]
    give_back()
    return whole, others


def usual_length(docs: DataFrame, models: list[Automaton]) -> float | None:
    """The median bits a byte, to a thousandth, of all texts with a letter; ``models[i]`` codes fold i of as many.

    One fold after another, so that driver and workers hold the trees of one.
    """
    found = None
    for i, model in enumerate(models):
        if model.labels:
            shared = docs.sparkSession.sparkContext.broadcast(model)
            rows = identify(docs.where(fold_of(folds=len(models)) == i).select("text"), shared, keep=[])
            rows = cut(rows.where(F.col("bits_per_byte").isNotNull()).groupBy(F.round("bits_per_byte", 3).alias("bits")).count())
            found = rows if found is None else found.unionByName(rows)
            shared.destroy()
    if found is None:
        return None
    return found.agg(F.percentile("bits", 0.5, F.col("count"))).first()[0]


def keep_identified(docs: DataFrame, model: Automaton, crossed: list[Automaton] | None = None) -> DataFrame:
    """The rows of ``docs`` that some learned language codes well enough, with their own columns.

    A text without a letter goes, and one whose code length under its language
    is above ``LIMIT`` times the median bits a byte of all rows, by more than
    ``SLACK_BITS``: noise, or no language that was learned.  The median is that
    of each row under trees that have not learned its text, which
    ``fit_crossed`` gives; without ``crossed``, under ``model``.  Where nothing
    was learned, all texts with a letter stay.
    """
    return keep_coded(docs, model, usual_length(docs, crossed or [model]))


def keep_coded(docs: DataFrame, model: Automaton, usual: float | None) -> DataFrame:
    """``keep_identified`` with the median bits a byte, ``usual``, at hand; no limit without it."""
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(columns)], F.col("text").alias("__t"),
                        F.octet_length("text").alias("__n"))
    if not model.labels:
        kept = named.where(F.regexp_like(F.coalesce("__t", F.lit("")), F.lit(r"\p{L}")))
    else:
        found = identify(named, model, "__t", keep=[*[f"__o{i}" for i in range(len(columns))], "__n"])
        kept = found.where(F.col("lang_pred") != UNKNOWN)
        if usual is not None:
            over = (F.col("bits_per_byte") - F.lit(LIMIT * usual)) * F.col("__n")
            kept = kept.where(~F.coalesce(over > SLACK_BITS, F.lit(False)))
    return kept.select(*[F.col(f"__o{i}").alias(c) for i, c in enumerate(columns)])
