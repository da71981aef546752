"""URL filter: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models (Witten-Bell) learn the URLs that
rules accept and reject.  Any other URL is judged by the difference of its
log-likelihoods divided by its length, against a threshold calibrated on the
rule-judged URLs: the value that best separates the two classes, weighting
both alike (half way between the neighbouring scores).  For the calibration each
half of them, by a hash of the URL, is scored by the models of the other half,
so the scores are those of unseen URLs; the models that judge learn from all.

Defined cases: a null URL, or one without ``://``, has an empty host and
path; a null or empty URL scores 0 and is allowed, as is every URL while one
of the two classes has no example.  Host labels compare whole
(``badexample.org`` is not under ``example.org``); ties of rules go to the
longest host, then the longest path, then block.  Repeated URLs count each time.
Columns of the input that an output column names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import cut, map_arrow, prepare
from wardflow.llm.context_model import Automaton, context_counts, count_grams, witten_bell_rows

ALLOW, BLOCK = "allow", "block"
#: Longest context.
ORDER = 5
#: Bins per bit of the calibration's histogram.
BINS = 200


@dataclass(frozen=True)
class Rule:
    """A rule for ``host`` and its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)"))
    raw = F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (its name or null) and rule_verdict (or null).

    The rule table is a parameter, so it compiles into one CASE expression.
    """
    from wardflow.llm.common import replacing
    keep = replacing(pages, ["host", "path", "rule", "rule_verdict"])
    base = pages.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col(f"`{url}`").alias("u"))
    base = base.withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u"))})
    order = sorted(rules, key=lambda r: (-len(r.name), r.verdict != BLOCK, r.name))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(order):
        fits = (((F.col("host") == r.host) | F.col("host").endswith("." + r.host))
                & F.col("path").startswith(r.path))
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return base.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "host", "path",
                       rule.alias("rule"), verdict.alias("rule_verdict"))


@dataclass
class UrlModel:
    """The two Markov models, and the least difference in bits a byte that is allowed."""

    trees: Automaton
    threshold: float


def _scored(pages: DataFrame, trees: Automaton, url: str) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    add = T.StructType([T.StructField("llr", T.DoubleType())])

    def make():
        model = shared.value

        def work(urls: pa.Array) -> list[pa.Array]:
            data = [u or b"" for u in urls.to_pylist()]
            if model.labels != [ALLOW, BLOCK]:
                return [pa.array(np.zeros(len(data)))]
            bits = model.code_lengths(data)
            return [pa.array((bits[:, 1] - bits[:, 0]) / np.maximum([len(d) for d in data], 1))]

        return work

    return map_arrow(pages, {url: "binary"}, add, make)


def fit(pages: DataFrame, rules: list[Rule], url: str = "url", order: int = ORDER) -> UrlModel:
    """Models of all rule-judged URLs and the cross-fitted threshold."""
    prepare(pages.sparkSession)
    known = cut(judged(pages.select(url), rules, url).where("rule_verdict is not null").select(
        F.col(url), "rule_verdict", F.pmod(F.xxhash64(F.lit("fold"), F.col(f"`{url}`")), F.lit(2)).alias("fold")))

    def learned(rows: DataFrame) -> Automaton:
        grams = count_grams(rows, "rule_verdict", url, order)
        return Automaton(context_counts(grams, order), order, witten_bell_rows)

    trees = learned(known)
    if trees.labels != [ALLOW, BLOCK]:
        return UrlModel(trees, float("-inf"))
    halves = [(known.where(F.col("fold") == f), learned(known.where(F.col("fold") != f))) for f in (0, 1)]
    if any(model.labels != [ALLOW, BLOCK] for _, model in halves):  # too few URLs to part
        halves = [(known, trees)]
    scored = [_scored(rows, model, url).select("llr", "rule_verdict") for rows, model in halves]
    # llr lies within 2 x 100 bits a byte: a bounded number of bins
    bins = (reduce(DataFrame.unionAll, scored).groupBy(F.floor(F.col("llr") * BINS).cast("long").alias("bin"))
            .agg(F.sum((F.col("rule_verdict") == ALLOW).cast("long")).alias("good"),
                 F.sum((F.col("rule_verdict") == BLOCK).cast("long")).alias("bad")).collect())
    bins.sort(key=lambda r: r.bin)
    good, bad = sum(r.good for r in bins), sum(r.bad for r in bins)
    best, at, passed_good, passed_bad = -1.0, float("-inf"), good, bad
    for before, r in zip([None, *bins], bins, strict=False):
        value = passed_good / good - passed_bad / bad  # allowing this bin and above
        if value > best:  # half way to the bin below
            best, at = value, (r.bin + (before.bin if before else r.bin)) / 2 / BINS
        passed_good -= r.good
        passed_bad -= r.bad
    return UrlModel(trees, at)


def filter_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and llr (bits a byte for allow)."""
    scored = _scored(judged(pages, rules, url), model.trees, url)
    by_model = F.when(F.floor(F.col("llr") * BINS) / BINS >= F.lit(model.threshold), ALLOW).otherwise(BLOCK)
    empty = F.coalesce(F.length(F.col(f"`{url}`")), F.lit(0)) == 0
    out = F.coalesce(F.col("rule_verdict"), F.when(empty, ALLOW), by_model)
    return scored.withColumn("verdict", out).drop("rule_verdict")
