"""Quality rules: a threshold table compiled into one projection.

Measures of a text are Spark expressions; ``THRESHOLDS`` lists, by measure,
the least and the most that a document may have.  Compiling it gives one
boolean column for each row and their conjunction, in one projection and
without user functions.

Words are runs without space, tab, line feed, vertical tab, form feed or
carriage return.  Repeated 8-word windows are found by a sort of the
windows' 64-bit hashes within the row.

Defined cases: a null or empty text has no words, all measures 0, and fails
on ``n_words``; ratios over 0 are 0; the stop-word rule holds for texts in
Latin script (by their bytes a character), as the list has no other words; a null doc_id and repeated rows are
judged as any row.  Columns of the input that an output column names are
replaced.  Texts are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import replacing

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8

#: Frequent words of languages in Latin script.
STOP_WORDS = ("the of and to in is that for it with der die und das den von zu mit ist im "
              "le la les de des et en un une que el los las y se por con para "
              "di il che per non del della sono da do em um uma com het een van niet dat op "
              "och att det inte na nie jest się w ve bir bu için").split()
#: Bytes a character from which a text is taken to be in another script.
OTHER_SCRIPT = 1.5


@dataclass(frozen=True)
class Threshold:
    """A document keeps when least <= measure <= most."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The rules.  A measure that does not apply to a text is null and passes: stop words in other scripts.
THRESHOLDS = (
    Threshold("length", "n_words", least=20),
    Threshold("mean_word", "mean_word_chars", least=1.5, most=20),
    Threshold("symbols", "symbol_ratio", most=0.05),
    Threshold("stop_words", "stop_ratio", least=0.02),
    Threshold("dup_lines", "dup_line_ratio", most=0.6),
    Threshold("stutter", "stutter_ratio", most=0.3),
    Threshold("repeats", "repeat_ratio", most=0.3),
)


def _n(a: Column) -> Column:
    return F.size(a).cast("long")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the base measures, each level one projection."""
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_stutter", "latin"]
    keep = replacing(docs.select(*[F.col(f"`{c}`") for c in keep]) if keep is not None else docs, out)
    kept = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    k = [F.col(f"__k{i}") for i in range(len(keep))]
    t = F.coalesce(F.col("t"), F.lit(""))
    # every array that a lambda reads is a column of the level below, read twice or more there
    words = F.filter(F.split(t, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0)
    base = docs.select(*kept, F.col(f"`{text}`").alias("t")).select(*k, t.alias("t"), words.alias("w"),
                                                                     lines.alias("lines"))
    # the window at i starts at word i; equal windows have equal hashes
    hashes = F.when(F.size("w") >= WINDOW, F.expr(
        f"transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64("
        + ", ".join(f"w[i + {j}]" for j in range(WINDOW)) + "))")).otherwise(F.expr("array()").cast("array<bigint>"))
    level = base.select(
        *k, _n(F.col("w")).alias("n_words"),
        F.length(F.regexp_replace("t", SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.octet_length("t") <= OTHER_SCRIPT * F.length("t")).alias("latin"),
        _n(F.col("lines")).alias("n_lines"),
        (_n(F.col("lines")) - _n(F.array_distinct("lines"))).alias("n_dup_lines"),
        _n(F.filter("w", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
        _n(F.expr("filter(w, (x, i) -> i > 0 and x = w[greatest(i - 1, 0)])")).alias("n_stutter"), hashes.alias("h"))
    plain = level.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.expr(
        "sort_array(transform(h, (x, i) -> struct(x as x, i as i)))")))
    starts = plain.withColumn("at", F.expr(
        "sort_array(transform(filter(s, (v, j) -> (j > 0 and s[greatest(j - 1, 0)].x = v.x) or "
        "(j < size(s) - 1 and s[least(j + 1, size(s) - 1)].x = v.x)), v -> v.i))"))
    covered = F.expr(f"aggregate(transform(at, (v, j) -> if(j = size(at) - 1, {WINDOW}, "
                     f"least({WINDOW}, at[least(j + 1, size(at) - 1)] - v))), 0L, (a, v) -> a + v)")
    return starts.select(*[c.alias(n) for c, n in zip(k, keep, strict=True)],
                         *[c for c in out if c != "n_repeat_words"],
                         F.when(F.col("at").isNull(), F.lit(0).cast("long")).otherwise(covered).alias("n_repeat_words"))


def compile_rules(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> tuple[Column, Column]:
    """(kept, names of the rules that failed) of a threshold table, as two expressions."""
    ok, failed = F.lit(True), []
    for t in thresholds:
        value = F.col(t.measure)
        fine = F.lit(True)
        if t.least is not None:
            fine = fine & F.coalesce(value >= t.least, F.lit(True))
        if t.most is not None:
            fine = fine & F.coalesce(value <= t.most, F.lit(True))
        ok = ok & fine
        failed.append(F.when(~fine, F.lit(t.name)))
    return ok, F.array_compact(F.array(*failed))


def judge(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """``docs`` with measures, ratios, ``failed`` (rule names) and ``kept``."""
    out = measures(docs, text, keep)
    ratios = {"mean_word_chars": _ratio("word_chars", "n_words"), "symbol_ratio": _ratio("n_symbols", "word_chars"),
              "stop_ratio": F.when(F.col("latin"), _ratio("n_stop", "n_words")),
              "stutter_ratio": _ratio("n_stutter", "n_words"), "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
              "repeat_ratio": _ratio("n_repeat_words", "n_words")}
    out = out.withColumns(ratios)
    kept, failed = compile_rules(thresholds)
    return out.withColumns({"kept": kept, "failed": failed})
