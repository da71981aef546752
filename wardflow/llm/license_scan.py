"""License scan: exact set-similarity join of text blocks with templates.

Blocks are, for each template length, overlapping runs of the whole word sequence, across
line breaks: twice as long as the template, a run every half template, so any
passage of one and a half times its words lies within a run.  Runs meet only templates of
their length, and are made only in texts that have the words of one.  A block
meets a template when it holds at least ``CONTAINMENT`` of the template's
distinct words.  Tokens are ordered
by their frequency over all blocks, rarest first.  A template must then share
one of its first |T| - o + 1 tokens with the block (o: the words needed); the
join is on these prefix tokens, the length filter asks the block for o template
words, the positional filter for enough words after the shared one, and
the exact overlap confirms the pair.  Words that no template has can't
change an overlap, so blocks are kept as their template words only.  A pair
that meets is a label only if as many of the template's words stand in the
template's order in the block (longest common subsequence).

Places of the base phrases are found besides, over the whole word sequence.

Defined cases: null and empty texts have no words, blocks or labels, score 0;
a null doc_id and repeated rows are results of their own; a block with the
words of several templates gets all their labels.  Input columns are not
carried, except ``keep``.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import cut, prepare, replacing

CONTAINMENT = 0.9
#: Between words; upper case is lower-cased first.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower-cases to an ASCII letter, though it isn't one.
KELVIN = "K"


#: Length of the longest common subsequence of ``words`` and ``seq``: for each template word in turn the longest
#: one that ends at each place of the block.
IN_ORDER = ("array_max(aggregate(words, array_repeat(0, size(seq)), (ends, word) -> transform(ends, (n, i) -> "
            "if(seq[i] = word, greatest(n, 1 + coalesce(array_max(slice(ends, 1, i)), 0)), n))))")


@dataclass(frozen=True)
class Template:
    label: str
    text: str


#: Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Usual license sentences, with punctuation taken as spaces.
TEMPLATES = (
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "licensed under the gnu general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms"),
    Template("lgpl", "licensed under the gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by", "licensed under cc by 4 0 international"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by", "licensed under a creative commons attribution international license"),
    Template("proprietary", "all rights reserved"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("agpl", "licensed under the gnu affero general public license"),
    Template("epl", "made available under the terms of the eclipse public license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("boost", "distributed under the boost software license version 1 0"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike international license"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _need(template: Template, containment: float) -> int:
    return math.ceil(containment * len(set(template.text.split())) - 1e-9)


def _runs(mine: list[Template], containment: float) -> Column:
    """Blocks of the word sequence ``w`` for templates of one length; ``tw`` has its distinct template words."""
    m, least = len(mine[0].text.split()), min(_need(t, containment) for t in mine)
    there = [F.size(F.array_intersect("tw", _strings(sorted(set(t.text.split()))))) >= _need(t, containment)
             for t in mine]
    words = _strings(sorted({w for t in mine for w in t.text.split()}))
    # the template words of a run in their order, repeats included
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(max(1, m // 2)))
    run = F.transform(starts, lambda i: F.struct(
        F.lit(m).alias("span"), F.filter(F.slice("w", i + 1, F.lit(2 * m)), lambda x: F.array_contains(words, x)).alias("tokens")))
    return F.when((F.size("w") > 0) & reduce(or_, there),
                  F.filter(run, lambda x: F.size(F.array_distinct(x["tokens"])) >= least))


def tokenised(docs: DataFrame, templates: tuple[Template, ...], containment: float, text: str,
              keep: list[str]) -> DataFrame:
    """Per row: kept columns, a row id, n_words, phrase places and the blocks' template words."""
    vocabulary = _strings(sorted({w for t in templates for w in t.text.split()}))
    kept = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    k = [F.col(f"__k{i}") for i in range(len(keep))]
    plain = F.lower(F.replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(KELVIN), F.lit("é")))
    words = docs.select(*kept, F.array_remove(F.split(plain, BETWEEN), "").alias("w"))
    words = words.select(*k, "w", F.array_intersect("w", vocabulary).alias("tw"))
    none = F.expr("cast(array() as array<struct<span: int, tokens: array<string>>>)")
    by_length: dict[int, list[Template]] = {}
    for t in templates:
        by_length.setdefault(len(t.text.split()), []).append(t)
    blocks = F.concat(*[F.coalesce(_runs(mine, containment), none) for mine in by_length.values()])
    # a place is looked for only in texts that have every phrase's last word
    fits = " or ".join(
        "(" + " and ".join(f"get(w, i + {j}) = '{word}'" for j, word in enumerate(phrase.split())) + ")"
        for phrase, _ in PHRASES)
    last = sorted({phrase.split()[-1] for phrase, _ in PHRASES})
    places = F.when(F.arrays_overlap(F.col("w"), _strings(last)), F.expr(
        f"filter(sequence(0, size(w) - 1), i -> {fits})")).otherwise(F.expr("cast(array() as array<int>)"))
    placed = words.select(*k, F.size("w").cast("long").alias("n_words"), "w", blocks.alias("blocks"), places.alias("places"))
    label = F.expr(
        "transform(places, p -> case " + " ".join(
            f"when w[p] = '{phrase.split()[0]}' then '{name}'" for phrase, name in PHRASES) + " end)")
    return placed.select(F.monotonically_increasing_id().alias("row"), *k, "n_words", "blocks",
                         F.size("places").cast("long").alias("n_base"),
                         F.array_min("places").cast("long").alias("first_word"),
                         F.array_max("places").cast("long").alias("last_word"),
                         F.array_sort(F.array_distinct(label)).alias("base"))


def similarity_join(blocks: DataFrame, templates: tuple[Template, ...], containment: float) -> DataFrame:
    """(row, block, label, containment) of every block and template that meet the threshold."""
    spark = blocks.sparkSession
    seen = {r.token: r.n for r in blocks.select(F.explode("tokens").alias("token"))
            .groupBy("token").agg(F.count("*").alias("n")).collect()}  # at most the templates' vocabulary
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    prefixes = []
    for n, t in enumerate(templates):
        ids = sorted(rank[w] for w in set(t.text.split()))
        need = _need(t, containment)
        row = (n, t.label, [rank[w] for w in t.text.split()], math.ceil(containment * len(t.text.split()) - 1e-9), ids, need)
        prefixes += [(*row, i, ids[i]) for i in range(len(ids) - need + 1)]
    table = spark.createDataFrame(
        prefixes, "template int, label string, words array<int>, in_order int, ids array<int>, need int, t_at int, token int")
    ranks = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    ordered = blocks.select("row", "block", "span", F.transform("tokens", lambda w: ranks[w]).alias("seq")).select(
        "row", "block", "span", "seq", F.sort_array(F.array_distinct("seq")).alias("b"))
    probes = ordered.select("row", "block", "span", "seq", "b", F.posexplode("b").alias("b_at", "token"))
    joined = probes.join(F.broadcast(table), "token")  # the templates are a parameter: bounded
    fits = (F.col("span") == F.size("words")) & (F.size("b") >= F.col("need")) & (
        F.least(F.size("ids") - F.col("t_at"), F.size("b") - F.col("b_at")) >= F.col("need"))
    share = F.size(F.array_intersect("b", "ids"))
    found = joined.where(fits).withColumn("shared", share).where(F.col("shared") >= F.col("need"))
    found = found.groupBy("row", "block", "template").agg(
        F.first("label").alias("label"), F.max(F.col("shared") / F.size("ids")).alias("containment"),
        F.first("seq").alias("seq"), F.first("words").alias("words"), F.first("in_order").alias("in_order"))
    return found.where(F.expr(IN_ORDER) >= F.col("in_order")).select("row", "block", "label", "containment")


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, containment: float = CONTAINMENT,
                  text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: n_words, n_base, first_word, last_word, base and labels (arrays), score.

    ``keep`` (all columns) is carried; columns that the result names are replaced.
    """
    prepare(docs.sparkSession)
    out = ["n_words", "n_base", "first_word", "last_word", "base", "labels", "score"]
    keep = replacing(docs, out) if keep is None else keep
    rows = cut(tokenised(docs, templates, containment, text, keep))
    blocks = rows.select("row", F.posexplode("blocks").alias("block", "b")).select("row", "block", "b.span", "b.tokens")
    found = similarity_join(blocks, templates, containment).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    out = rows.drop("blocks").join(found, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.expr("cast(array() as array<string>)"))))
    score = F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_base", "first_word",
                      "last_word", "base", labels.alias("labels"), score.alias("score"))
