"""Toxicity by maximum-scoring segments.

Token log-odds between toxic and clean labelled texts carry a Dirichlet prior
taken from the token counts of the whole corpus; a token's score is its
log-odds drawn towards 0 by their uncertainty, less a small drift, so that
ordinary text has a negative expected score.  A linear scan finds every
maximal-scoring segment.  Scores of segments follow an extreme-value law in
clean text: lambda follows from the clean token scores, K is fitted to the best segments
of clean labelled texts by maximum likelihood.  A segment is significant when its
expected number of equals in that much clean text is below ``EVALUE``.  A document's evidence is the sum of its
significant segments' excess over that level.  Evidence becomes a probability
by a calibration on labelled rows: each half of them is scored by the tokens of
the other half, so no row judges itself; the final scores use both halves.

Defined cases: a null, empty or word-free text has no evidence, and gets the
probability of that; without toxic or without clean examples every score is
about the base rate and no segment exists.  A doc_id with several label
rows is toxic if any says so; rows with a null label teach nothing; repeated
documents count each time.  Texts are scanned whole.
Columns of the input that an output column names are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import cut, gather_arrow, map_arrow, prepare
from wardflow.llm.words import words_of

#: Labelled documents that teach, about: the bounded sample, chosen by a hash of doc_id.
#: It bounds the tokens with a score, too: those whose log-odds differ from 0 by CAUTION standard errors.
MAX_LABELLED = 400_000
#: K before it is fitted, and where no clean text has a segment.
START_K = 0.1
#: Strength of the Dirichlet prior as a share of the labelled tokens, and the standard errors taken off a log-odds.
PRIOR = 0.1
CAUTION = 2.0
DRIFT = 0.1
#: Expected number of clean segments of that score in one document.
EVALUE = 0.1
#: Distinct tokens that a task holds before it writes them out.
FLUSH_TOKENS = 400_000
BINS_PER_UNIT = 4
MAX_BIN = 200


@dataclass
class ToxicityModel:
    scores: dict[bytes, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = START_K
    a: float = -2.0
    b: float = 0.0


def label_sample(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, toxic, half): about ``max_labelled`` labelled documents at most, by a hash of doc_id.

    The hash picks a share, so no task sorts or holds the sample.
    """
    one = cut(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("toxic") != 0).cast("int")).alias("toxic")))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return one.where(place < F.lit(max_labelled / max(one.count(), 1))).withColumn(
        "half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int"))


#: Token counts: of the corpus, then by class and half of the labelled rows.
COUNTS = ["n", "clean_0", "clean_1", "toxic_0", "toxic_1"]


def token_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, COUNTS) over every text of ``docs``; ``labels`` is the bounded sample."""
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id", "left").withColumn(
        "mark", F.col("toxic") * 2 + F.col("half"))
    out = T.StructType([T.StructField("token", T.BinaryType())] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def make():
        every, marked = Counter(), [Counter() for _ in range(4)]

        def drain():
            if not every:
                return None
            tokens = list(every)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.binary()),
                 *[pa.array([c[t] for t in tokens], pa.int64()) for c in (every, *marked)]], names=out.names)
            for c in (every, *marked):
                c.clear()
            return batch

        def add(texts, marks):
            for data, mark in zip(texts.to_pylist(), marks.to_pylist(), strict=True):
                if data:
                    words = words_of(data)
                    every.update(words)
                    if mark is not None:
                        marked[mark].update(words)
            return drain() if len(every) > FLUSH_TOKENS else None

        return add, drain

    return (gather_arrow(rows, {"text": "binary", "mark": "int"}, out, make)
            .groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def log_odds(counts: DataFrame, halves: tuple[int, ...] = (0, 1), prior: float = PRIOR,
             caution: float = CAUTION) -> tuple[DataFrame, int]:
    """(token, score, n_clean) of the tokens whose log-odds differ from 0, and the clean tokens' number."""
    def by(kind: str):
        return sum((F.col(f"{kind}_{h}") for h in halves[1:]), F.col(f"{kind}_{halves[0]}"))

    rows = counts.select("token", "n", by("toxic").alias("n_toxic"), by("clean").alias("n_clean"))
    n, nt, nc = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_toxic", "n_clean")]).first()
    prior *= max(nt + nc, 1)
    alpha = F.col("n") * F.lit(prior / max(n, 1))

    def odds(c, total):
        return F.log((F.col(c) + alpha) / (F.lit(total + prior) - F.col(c) - alpha))

    delta = odds("n_toxic", nt) - odds("n_clean", nc)
    error = F.sqrt(1 / (F.col("n_toxic") + alpha) + 1 / (F.col("n_clean") + alpha))
    score = F.signum(delta) * F.greatest(F.abs(delta) - F.lit(caution) * error, F.lit(0.0))
    return rows.select("token", "n_clean", score.alias("score")).where("score <> 0"), nc


def scale_of(values: np.ndarray, weights: np.ndarray) -> float:
    """lambda with E[exp(lambda s)] = 1 under the clean token scores."""
    p = weights / weights.sum()
    if not (values > 0).any() or (p[values > 0].sum() <= 0):
        return 1.0
    lo, hi = 0.0, 1.0
    while (p * np.exp(np.minimum(hi * values, 500))).sum() < 1 and hi < 50:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        if (p * np.exp(np.minimum(mid * values, 500))).sum() < 1:
            lo = mid
        else:
            hi = mid
    return max(lo, 1e-3)


def maximal_segments(at: np.ndarray, gain: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a token sequence.

    ``at`` and ``gain``: the tokens with a score of their own; every token
    costs ``drift`` besides.  One pass with a stack of segments that hold the
    running sum before and after them; each is merged at most once.
    """
    total = np.cumsum(gain)
    before, after = total - gain - drift * at, total - drift * (at + 1)
    stack: list[tuple[int, int, float, float]] = []
    for i in np.flatnonzero(gain > drift).tolist():
        start, lo, hi = int(at[i]), before[i], after[i]
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= lo:
                j -= 1
            if j < 0 or stack[j][3] >= hi:
                break
            start, lo = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, int(at[i]) + 1, lo, hi))
    return [(s, e, float(hi - lo)) for s, e, lo, hi in stack]


def segments(words: list[bytes], model: ToxicityModel) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a text."""
    known = np.fromiter(map(model.scores.get, words, repeat(0.0)), np.float64, len(words))
    at = np.flatnonzero(known)
    return maximal_segments(at, known[at], DRIFT) if at.size else []


def significant(words: list[bytes], model: ToxicityModel) -> list[tuple[int, int, float]]:
    """Segments whose E-value K n exp(-lambda S) is below EVALUE, with the excess over that level."""
    if not words:
        return []
    level = math.log(model.k * len(words) / EVALUE)
    return [(s, e, model.lam * score - level) for s, e, score in segments(words, model) if model.lam * score > level]


def segment_scores(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """``keep`` with n_words and the scores of the maximal segments: what K and the evidence are made of."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    add = T.StructType([T.StructField("n_words", T.LongType()),
                        T.StructField("found", T.ArrayType(T.DoubleType()))])

    def make():
        fitted = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            words = [words_of(t) if t else [] for t in texts.to_pylist()]
            return [pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[x[2] for x in segments(w, fitted)] for w in words], pa.list_(pa.float64()))]

        return work

    return map_arrow(docs, {"text": "binary"}, add, make, keep)


def fitted_k(rows: DataFrame, lam: float) -> float:
    """K by maximum likelihood from clean texts' best segments.

    The best score S of n words has P(S < s) = exp(-K n exp(-lambda s)), so
    n exp(-lambda S) is exponential with rate K; a text without a segment says
    only that it is n at least.
    """
    best = F.array_max("found")
    seen, total = rows.where("n_words > 0").agg(
        F.count(best), F.sum(F.col("n_words") * F.exp(-F.lit(lam) * F.coalesce(best, F.lit(0.0))))).first()
    return seen / total if seen else START_K


def evidence(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with tox_evidence and tox_segments (first word, end word, excess)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    piece = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                          T.StructField("excess", T.DoubleType())])
    add = T.StructType([T.StructField("tox_evidence", T.DoubleType()),
                        T.StructField("tox_segments", T.ArrayType(piece))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("excess", pa.float64())]))

    def make():
        fitted = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            found = [significant(words_of(t), fitted) if t else [] for t in texts.to_pylist()]
            return [pa.array([sum(x[2] for x in f) for f in found], pa.float64()),
                    pa.array([[dict(zip(("start", "end", "excess"), x, strict=True)) for x in f]
                              for f in found], kind)]

        return work

    return map_arrow(docs, {"text": "binary"}, add, make, keep)


def _calibrate(bins: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Logistic regression of the label on log(1 + evidence), by bins (bin, n, toxic)."""
    if not bins:
        return -2.0, 0.0
    x = np.array([b / BINS_PER_UNIT for b, _, _ in bins])
    n, y = np.array([b[1] for b in bins], float), np.array([b[2] for b in bins], float)
    w = np.array([math.log((y.sum() + 1) / (n.sum() - y.sum() + 1)), 0.0])
    feats = np.stack([np.ones_like(x), x])

    def loss(v: np.ndarray) -> float:
        z = v @ feats
        return float((n * np.logaddexp(0, z) - y * z).sum() + 0.005 * v @ v)

    for _ in range(100):  # Newton's method, halving steps that don't help
        p = 1 / (1 + np.exp(-np.clip(w @ feats, -30, 30)))
        grad = feats @ (y - n * p) - 0.01 * w
        step = np.linalg.solve((feats * (n * p * (1 - p))) @ feats.T + 0.01 * np.eye(2), grad)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _bin():
    return F.least(F.floor(F.log1p("tox_evidence") * BINS_PER_UNIT), F.lit(MAX_BIN)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Scores, extreme-value parameters and calibration.

    ``docs``: all documents (the prior counts every text); ``labels``: doc_id
    and toxic of the rows that may teach.
    """
    prepare(docs.sparkSession)
    sample = label_sample(labels, max_labelled)
    counts = cut(token_counts(docs, sample))
    taught = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    bins: Counter = Counter()
    ks = []
    for half in (0, 1):  # each half is judged by the tokens and the K of the other rows
        model = _learned(counts, (1 - half,))
        rows = cut(segment_scores(taught.where(F.col("half") == half), model, keep=["toxic"]))
        model.k = fitted_k(rows.where("toxic = 0"), model.lam)
        ks.append(model.k)
        for b, n, toxic in (rows.withColumn("tox_evidence", _evidence(model)).groupBy(_bin().alias("bin"))
                            .agg(F.count("*"), F.sum("toxic")).collect()):
            bins[b, 0] += n
            bins[b, 1] += toxic
    model = _learned(counts, (0, 1))
    model.k = math.sqrt(ks[0] * ks[1])
    model.a, model.b = _calibrate([(b, bins[b, 0], bins[b, 1]) for b in sorted({b for b, _ in bins})])
    return model


def _evidence(model: ToxicityModel):
    """The significant segments' excess of a row of ``segment_scores``."""
    level = F.log(F.lit(model.k / EVALUE) * F.greatest(F.col("n_words"), F.lit(1)))
    return F.aggregate("found", F.lit(0.0), lambda a, s: a + F.greatest(F.lit(model.lam) * s - level, F.lit(0.0)))


def _learned(counts: DataFrame, halves: tuple[int, ...]) -> ToxicityModel:
    """Token scores and lambda from some halves of the labelled rows."""
    odds, clean = log_odds(counts, halves)
    rows = odds.collect()  # bounded by the labelled sample
    model = ToxicityModel({bytes(r.token): r.score for r in rows})
    known = sum(r.n_clean for r in rows)
    values = np.array([r.score - DRIFT for r in rows] + [-DRIFT])
    weights = np.array([r.n_clean + 0.5 for r in rows] + [max(clean - known, 1.0)], float)
    model.lam = scale_of(values, weights)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3,
                   keep: list[str] | None = None) -> DataFrame:
    """``docs`` with tox_evidence, tox_segments, score (0 to 1) and predicted (score >= threshold)."""
    out = evidence(docs, model, keep)
    score = 1 / (1 + F.exp(-(F.lit(model.a) + F.lit(model.b) * F.log1p("tox_evidence"))))
    return out.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
