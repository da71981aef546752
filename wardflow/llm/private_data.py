"""Personal data by weak supervision, with DataFrame functions only.

Base spans come from fixed patterns (e-mail, IPv4, card with Luhn check,
phone).  Further candidates are ASCII runs with digits, short values after a
secret word, grouped numbers (IBAN, phones without +, ids), capitalised words
after a name cue or beginning with a listed first name, street addresses and
dates after a birth cue.  Each class is judged by itself, without any
labels: a regex labeler, a gazetteer labeler and a context labeler vote
(for, against or silent).  Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability and a posterior for each
pattern; those posteriors, as soft labels, train a naive Bayes classifier
over the span's shape, which decides every candidate, silent ones included.
Only counts by vote pattern and shape reach the driver; their number is
bounded by the labelers and features, not by the corpus.

Patterns are written so that Java matches them without recursion and in
linear time: runs start only where the run starts (or where the last
match ended), and repeats are of single characters.

Defined cases: a null text is an empty one, without spans; spans are code
points, end exclusive; a candidate that overlaps a base span is dropped, as is
one that overlaps an accepted one of an earlier class;
without candidates nothing is trained; a null doc_id and repeated rows are
results of their own.  Columns other than ``keep`` (all) are not carried; those that the result names are replaced.
"""

from __future__ import annotations

import math
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import cut, prepare, replacing

KINDS = ("email", "ip", "card", "phone", "secret", "number", "name", "address", "date")

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    # the domain ends before a dot without a label, another character or the end
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?=\.{_LABEL})"
             rf"[A-Za-z0-9.-]*?(?=\.(?!{_LABEL})|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of digits with single separators between them; runs under 12 digits can't be cards
    "card": r"[0-9](?=(?:[ -]?[0-9]){11})[0-9 -]*?(?=[ -](?![0-9])|[^0-9 -]|\z)",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must match before its pattern runs.
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9][A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{9,}"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: The labelers' word lists.
SECRET_PREFIXES = "AKIA|ASIA|ghp_|gho_|xoxb-|xoxp-|sk_live_|sk-|AIza|glpat-"
PLAIN_PREFIXES = "ISBN|ISSN|RFC|UTF|SHA|MD5|doi|v[0-9]"
SECRET_WORDS = "password|passwd|pwd|passwort|contrase|secret|token|api.?key|key|clave|passport|ssn|iban|account"
PLAIN_WORDS = "page|chapter|version|isbn|issn|figure|table|section|line|row"

SHORT_WORDS = ("password|passwd|passwort|passcode|pwd|pin|contraseña|mot de passe|account(?: number| no\\.?)?|"
               "konto(?:nummer)?|token|secret|api.?key")
NUMBER_WORDS = r"phone|tel\b|call|mobile|fax|iban|account|konto|ssn|passport|\bid\b|téléphone|teléfono|telefon"
NAME_WORDS = (r"(?i:\bname(?:d| is)?|\bcalled|\bdear|\bcontact|\bsigned|\bpatient|\bcustomer|\bheißt|s'appelle|\bse llama)"
              r"|\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señora?|Sra?|Monsieur|Madame|Mme)")
FIRST_NAMES = ("James|John|Robert|Michael|William|David|Mary|Patricia|Jennifer|Linda|Elizabeth|Susan|Sarah|Emma|Alice|Anna|"
               "Thomas|Peter|Hans|Klaus|Jürgen|Stefan|Andreas|Ursula|Sabine|Petra|Monika|Jean|Pierre|Michel|Marie|Sophie|"
               "Camille|Isabelle|José|Juan|Carlos|Luis|Miguel|Carmen|Lucía|Ana|Pedro|Pablo|Sofía")
PLAIN_NAMES = ("Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|"
               "September|October|November|December|Sir|Madam|The|This|Reader|Customer|All")
PLACES = ("London|Manchester|New York|Chicago|Boston|Berlin|Hamburg|München|Munich|Köln|Wien|Zürich|Paris|Lyon|Marseille|"
          "Bruxelles|Madrid|Barcelona|Sevilla|Valencia|Roma")
PLAIN_VALUES = "reset|policy|change|changed|required|protected|manager|field|holder|based|only|free|number|security|forgotten"
ORGANISATIONS = "Street|Road|Avenue|Square|University|College|Company|Inc|Ltd|GmbH|AG|Foundation|Hospital|Museum|Bridge|Park"
WAYS = "walk(?:ed)?|drove|along|down|across|through|past|crossed|sur|dans|durch|entlang|por"
BORN_THINGS = "nation|idea|company|movement|project|again|tradition"
_WORD = r"\p{Lu}[\p{L}'’-]{1,30}"
#: Candidates by cue or grouping: the last group is the span, at the match's end.
CUED = {
    "short": rf"""(?i:\b(?:{SHORT_WORDS})(?: is| ist| est| es)?\s?[:=#]?\s?["']?)([^\s"',;:=]{{4,8}})(?![^\s"',;.!?)])""",
    "number": r"(?<![\p{L}0-9.,/-])([A-Z]{2}[0-9]{2}(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?|\([0-9]{2,5}\) ?[0-9]{2,5}"
              r"(?:[ -][0-9]{2,5}){0,3}|[0-9]{2,5}(?:[ -][0-9]{2,5}){2,7})(?![\p{L}0-9])",
    "name": rf"(?:(?:{NAME_WORDS})[.:]?\s|(?<!\p{{L}})(?=(?:{FIRST_NAMES}) \p{{Lu}}))({_WORD}(?: {_WORD}){{0,3}})",
    "address": rf"(?<![\p{{L}}0-9])([0-9]{{1,5}}[a-z]? (?:{_WORD} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|"
               rf"Blvd|Court|Square)|\p{{Lu}}\p{{L}}{{1,30}}(?:straße|strasse|str\.|weg|platz|allee|gasse) [0-9]{{1,4}}[a-z]?|"
               rf"(?:[0-9]{{1,4}},? )?(?:rue|avenue|boulevard|calle|avenida|plaza|paseo) (?:(?:de|du|des|la|le|les|del|los) )"
               rf"{{0,2}}{_WORD}(?: [0-9]{{1,4}})?)(?!\p{{L}})",
    "date": r"(?i:\b(?:born|date of birth|birth(?:day| date)?|dob|geboren|geburtsdatum|née?|nacid[oa]|nacimiento)\b(?: on| am| le| el| is)?"
            r"[: ]{1,2})([0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}|[0-9]{1,2}\.? \p{L}{3,10} [0-9]{4}|\p{L}{3,10} [0-9]{1,2},? [0-9]{4})",
}
#: The classes of candidates, judged apart, and the kind of each one's spans.
CLASSES = {"secret": "secret", "short": "secret", "number": "number", "name": "name", "address": "address", "date": "date"}

#: Characters before and after a candidate that the labelers see.
CONTEXT = 24
#: Matches whose places are summed together.
BLOCK = 64
THRESHOLD = 0.5


def _found(text: str, pattern: str, guard: str) -> tuple[Column, Column]:
    """(pieces between the matches, matches), null for texts that the guard excludes."""
    there = F.col(text).rlike(guard)
    return (F.when(there, F.split(F.col(text), pattern, -1)),
            F.when(there, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))))


def _spans(kind: str) -> Column:
    """array<struct<s, e, m, b, a>> of a kind's matches: place, match, text before and after.

    Running sums go block by block, so the cost grows with the matches, not with their square.
    What is before and after reaches back over the last match and on over the next one.
    """
    p, m = f"p_{kind}", f"m_{kind}"
    length = f"length({p}[i]) + length({m}[i])"
    starts = (f"aggregate(sequence(0, (size({m}) - 1) div {BLOCK}), array(0), (a, b) -> concat(a, array(a[b] + aggregate("
              f"sequence(b * {BLOCK}, least(size({m}), (b + 1) * {BLOCK}) - 1), 0, (n, i) -> n + {length}))))")
    around = ""
    if kind in CLASSES:
        around = (f", 'b', right(concat(if(i > 0, concat({p}[i - 1], {m}[i - 1]), ''), {p}[i]), {CONTEXT})"
                  f", 'a', left(concat({p}[i + 1], if(i + 1 < size({m}), {m}[i + 1], '')), {CONTEXT})")
    last = "if(size(a) > 0, a[size(a) - 1].e, f)"
    one = f"named_struct('s', {last} + length({p}[i]), 'e', {last} + {length}, 'm', {m}[i]{around})"
    empty = "cast(array() as array<struct<s: int, e: int, m: string" + (", b: string, a: string" if around else "") + ">>)"
    block = (f"aggregate(sequence(b * {BLOCK}, least(size({m}), (b + 1) * {BLOCK}) - 1), {empty}, "
             f"(a, i) -> concat(a, array({one})))")
    firsts = f"slice({starts}, 1, (size({m}) - 1) div {BLOCK} + 1)"
    return F.when(F.size(m) > 0, F.expr(f"flatten(transform({firsts}, (f, b) -> {block}))"))


def _values(name: str) -> Column:
    """The spans of a class's matches without their cues, which go to the text before."""
    if name not in CUED:
        return F.col(name)

    def value(x: Column) -> Column:
        mine = F.regexp_extract(x["m"], CUED[name], 1)
        cue = F.substr(x["m"], F.lit(1), F.length(x["m"]) - F.length(mine))
        return F.struct((x["e"] - F.length(mine)).alias("s"), x["e"].alias("e"), mine.alias("m"),
                        F.right(F.concat(x["b"], cue), F.lit(CONTEXT)).alias("b"), x["a"].alias("a"))

    return F.transform(name, value)


def _meets(spans: str, x: Column) -> Column:
    """Whether ``x`` overlaps one of ``spans``, which are in order and apart: by bisection."""
    steps = F.expr(f"sequence(1, cast(ceil(log2(size({spans}) + 1)) as int))")

    def step(r: Column, _: Column) -> Column:
        mid = ((r["lo"] + r["hi"]) / 2).cast("int")
        left = F.get(F.col(spans), mid)["s"] < x["e"]
        return F.struct(F.when((r["lo"] < r["hi"]) & left, mid + 1).otherwise(r["lo"]).alias("lo"),
                        F.when((r["lo"] < r["hi"]) & ~left, mid).otherwise(r["hi"]).alias("hi"))

    begun = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), step)["lo"]
    return F.when(F.size(spans) > 0, F.coalesce(F.get(F.col(spans), begun - 1)["e"] > x["s"], F.lit(False))).otherwise(F.lit(False))


def _luhn(m: Column) -> Column:
    digits = F.reverse(F.regexp_replace(m, "[ -]", ""))
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(
        i % 2 == 1, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
        F.substr(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(digits, i, F.lit(1)) >= "5", 9).otherwise(0)))
    return F.length(digits).between(12, 19) & (F.when(F.length(digits).between(12, 19), total) % 10 == 0)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"\A{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _votes(name: str, m: Column, before: Column, after: Column) -> Column:
    """The three labelers' votes (shape, gazetteer, context) as text: + for, - against, 0 silent."""
    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, "+").when(no, "-").otherwise("0")

    if name == "secret":
        shape = vote(m.rlike(r"\A(?:[A-Z]{4}[A-Z0-9]{16}|(?=.*[a-f])(?=.*[0-9])[0-9a-f]{16,}|[0-9]{3}-[0-9]{2}-[0-9]{4})\z"),
                     m.rlike(r"\A(?:[A-Za-z]++[0-9]{1,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}.*|[0-9]++)\z"))
        gazetteer = vote(m.rlike(rf"\A(?:{SECRET_PREFIXES})") | before.rlike(rf"(?i)(?:{SECRET_WORDS})"),
                         m.rlike(rf"\A(?:{PLAIN_PREFIXES})") | before.rlike(rf"(?i)(?:{PLAIN_WORDS})\W*\z"))
        context = vote(before.rlike(r"""[=:]\s*["']?\z"""), before.rlike(r"[.,;]\s\z"))
    elif name == "short":
        shape = vote(m.rlike(r"[0-9]") | m.rlike(r"[^\p{L}.!?)]."), m.rlike(r"\A\p{L}+[.!?)]*\z"))
        gazetteer = vote(before.rlike(r"(?i)(?:pass(?:word|wd|wort|code)|pwd|\bpin|contraseña|mot de passe|account|konto)")
                         & ~m.rlike(rf"(?i)\A(?:{PLAIN_VALUES})[.!?)]*\z"), m.rlike(rf"(?i)\A(?:{PLAIN_VALUES})[.!?)]*\z"))
        context = vote(before.rlike(r"""[=:#]\s?["']?\z"""), before.rlike(r"\p{L} \z"))
    elif name == "number":
        shape = vote(m.rlike(r"\A(?:[A-Z]{2}|\(|0|[0-9]{3}-[0-9]{2}-[0-9]{4}\z)"),
                     m.rlike(r"\A(?:(?:1[0-9]|20)[0-9]{2}[ -]|[0-9]{2}-[0-9]{2}-[0-9]{4}\z|[0-9]{2}(?: [0-9]{2})+\z)"))
        gazetteer = vote(before.rlike(rf"(?i)(?:{NUMBER_WORDS})"), before.rlike(rf"(?i)(?:{PLAIN_WORDS})\W*\z"))
        context = vote(before.rlike(r"[=:#]\s?\z"), before.rlike(r"[0-9,;]\s\z"))
    elif name == "name":
        shape = vote(m.rlike(r"\A\p{Lu}\p{Ll}+(?: \p{Lu}[\p{L}'’-]+){1,2}\z"), m.rlike(r"\A\p{Lu}+\z"))
        gazetteer = vote(m.rlike(rf"\A(?:{FIRST_NAMES})(?!\p{{L}})"),
                         m.rlike(rf"\A(?:{PLAIN_NAMES}|{PLACES})(?!\p{{L}})"))
        context = vote(before.rlike(r"(?:\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señora?|Sra?|Monsieur|Madame|Mme)\.?|(?i:name(?: is)?:?))\s\z"),
                       m.rlike(rf" (?:{ORGANISATIONS})\z") | after.rlike(rf"\A\W?\s?(?:{ORGANISATIONS})(?!\p{{L}})"))
    elif name == "address":
        shape = vote(m.rlike("[0-9]"), ~m.rlike("[0-9]"))
        gazetteer = vote(after.rlike(rf"\A\W{{1,3}}(?:[0-9]{{4,5}}|(?:in )?(?:{PLACES}))"),
                         before.rlike(rf"(?i)(?:{PLAIN_WORDS})\W*\z"))
        context = vote(before.rlike(r"(?i)(?:address|adresse|dirección|lives?|wohnt|habite|vive)\W*(?:at|in|en|à|au)?\W*\z"),
                       before.rlike(rf"(?i)\b(?:{WAYS})\W*(?:the|la|le|die|der|el)?\W*\z"))
    else:
        shape = vote(m.rlike(r"(?:1[89]|20)[0-9]{2}"), ~m.rlike(r"[0-9]{4}"))
        gazetteer = vote(before.rlike(r"(?i)(?:birth|dob|geburt|nacimiento|geboren|born)")
                         & ~before.rlike(rf"(?i)(?:{BORN_THINGS})"), before.rlike(rf"(?i)(?:{BORN_THINGS})"))
        context = vote(before.rlike(r"(?i)(?::\s?|\b(?:on|am|le|el) )\z"), after.rlike(r"\A\s?(?:[0-9%]|[-/][0-9])"))
    return F.concat(shape, gazetteer, context)


def _shape(m: Column, before: Column) -> list[Column]:
    """The classifier's features, each with a few values."""
    n = F.length(m)
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return [
        F.concat(F.lit("n"), F.least(n / 4, F.lit(10)).cast("int").cast("string")),
        F.concat(F.lit("d"), (digits * 4 / n).cast("int").cast("string")),
        F.concat(F.lit("u"), m.rlike("[A-Z]").cast("int").cast("string"), m.rlike("[a-z]").cast("int").cast("string"),
                 m.rlike("[g-z]").cast("int").cast("string"), m.rlike("[_-]").cast("int").cast("string")),
        F.concat(F.lit("b"), F.when(before.rlike(r"""["']\z"""), "q").when(before.rlike(r"[=:]\s*\z"), "a")
                 .when(before.rlike(r"\s\z"), "s").otherwise("o")),
    ]


def candidates(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Kept columns, ``base`` (kind, s, e) and ``cand`` (c: class, s, e, votes, f): the pass over the texts."""
    k = [F.col(f"__k{i}") for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)],
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    found = dict(PATTERNS) | {"secret": CANDIDATE} | CUED
    parts = []
    for kind, pattern in found.items():
        pieces, matches = _found("t", pattern, GUARDS.get(kind, pattern))
        parts += [pieces.alias(f"p_{kind}"), matches.alias(f"m_{kind}")]
    rows = rows.select(*k, *parts)
    rows = rows.select(*k, *[_spans(x).alias(x) for x in found])
    none = "cast(array() as array<struct<s: int, e: int>>)"

    def valid(kind: str) -> Column:
        good = F.filter(kind, lambda x: _valid(kind, x["m"]))
        return F.coalesce(F.transform(good, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), F.expr(none))

    bases = [f"b_{kind}" for kind in KINDS[:4]]
    rows = rows.select(*k, *[valid(kind).alias(f"b_{kind}") for kind in KINDS[:4]], *[_values(x).alias(x) for x in CLASSES])

    def free(name: str) -> Column:
        return F.filter(name, lambda x: ~reduce(or_, [_meets(b, x) for b in bases]))

    rows = rows.select(*k, *bases, *[free(x).alias(x) for x in CLASSES])

    def described(name: str, x: Column) -> Column:
        return F.struct(F.lit(list(CLASSES).index(name)).alias("c"), x["s"].alias("s"), x["e"].alias("e"),
                        _votes(name, x["m"], x["b"], x["a"]).alias("votes"),
                        F.array(*_shape(x["m"], x["b"])).alias("f"))

    nothing = F.expr("cast(array() as array<struct<c: int, s: int, e: int, votes: string, f: array<string>>>)")
    cand = [F.coalesce(F.transform(n, partial(described, n)), nothing) for n in CLASSES]
    return rows.select(*k, F.concat(*[F.transform(x, partial(_kinded, i)) for i, x in enumerate(bases)]).alias("base"), F.concat(*cand).alias("cand"))


def reliabilities(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], float]:
    """EM over vote patterns: (posterior of each pattern, share of true spans).

    Each labeler has a distribution over its three votes for true and for
    false spans; started from the majority of the votes.
    """
    if not patterns:
        return {}, 0.5
    many = len(next(iter(patterns)))
    post = {p: {0: 0.3}.get(p.count("+") - p.count("-"), 0.95 if p.count("+") > p.count("-") else 0.05)
            for p in patterns}
    prior = 0.5
    for _ in range(rounds):
        total = sum(patterns.values())
        true = sum(n * post[p] for p, n in patterns.items())
        prior = min(max(true / total, 0.001), 0.999)
        like = []
        for j in range(many):
            table = {}
            for v in "+0-":
                t = sum(n * post[p] for p, n in patterns.items() if p[j] == v)
                f = sum(n * (1 - post[p]) for p, n in patterns.items() if p[j] == v)
                # a labeler is taken to be right more often than not
                lean = {"+": (1.0, 0.1), "0": (1.0, 1.0), "-": (0.1, 1.0)}[v]
                table[v] = ((t + lean[0]) / (true + 2.1), (f + lean[1]) / (total - true + 2.1))
            like.append(table)
        new = {}
        for p in patterns:
            a = math.log(prior) + sum(math.log(like[j][v][0]) for j, v in enumerate(p))
            b = math.log(1 - prior) + sum(math.log(like[j][v][1]) for j, v in enumerate(p))
            new[p] = 1 / (1 + math.exp(min(max(b - a, -60), 60)))
        change = max(abs(new[p] - post[p]) for p in patterns)
        post = new
        if change < 1e-9:
            break
    return post, prior


def span_classifier(rows: list[tuple[str, list[str], int]], post: dict[str, float],
                    prior: float) -> tuple[float, dict[str, float]]:
    """Naive Bayes over shape features from soft labels: (bias, log-odds of each feature)."""
    true: dict[str, float] = {}
    every: dict[str, float] = {}
    t_all = n_all = 0.0
    for votes, features, n in rows:
        t_all, n_all = t_all + n * post[votes], n_all + n
        for f in features:
            true[f] = true.get(f, 0.0) + n * post[votes]
            every[f] = every.get(f, 0.0) + n
    weights = {f: math.log((true[f] + 0.5) / (t_all + 1)) - math.log((every[f] - true[f] + 0.5) / (n_all - t_all + 1))
               for f in every}
    return math.log(prior / (1 - prior)), weights


def _of_class(i: int) -> Column:
    return F.filter("cand", lambda x: x["c"] == i)


def _apart(i: int) -> Column:
    """The spans of class ``i`` that meet none of an earlier class."""
    return F.filter(f"__c{i}", lambda x: ~reduce(or_, [_meets(f"__c{j}", x) for j in range(i)], F.lit(False)))


def _kinded(kind: int, x: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def find_private(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                 threshold: float = THRESHOLD) -> DataFrame:
    """Kept columns, ``base`` and ``spans``: arrays of (kind, s, e), by start, then kind as in KINDS."""
    prepare(docs.sparkSession)
    keep = replacing(docs, ["base", "spans"]) if keep is None else keep
    rows = cut(candidates(docs, text, keep))
    seen = (rows.select(F.explode("cand").alias("c")).groupBy("c.c", "c.votes", "c.f").agg(F.count("*").alias("n"))
            .collect())
    biases, shapes, votes = {}, {}, {}
    for i in sorted({r.c for r in seen}):  # each class by itself
        mine = [r for r in seen if r.c == i]
        patterns: dict[str, int] = {}
        for r in mine:
            patterns[r.votes] = patterns.get(r.votes, 0) + r.n
        post, prior = reliabilities(patterns)
        biases[i], weights = span_classifier([(r.votes, r.f, r.n) for r in mine], post, prior)
        shapes |= {f"{i}{f}": w for f, w in weights.items()}
        votes |= {f"{i}{p}": math.log(max(q, 1e-9) / max(1 - q, 1e-9)) for p, q in post.items()}
    if seen:
        bias, shape, vote = (F.create_map(*[F.lit(x) for f, w in sorted(d.items()) for x in (f, w)])
                             for d in (biases, shapes, votes))
        logit = math.log(threshold / (1 - threshold))

        def taken(c: Column) -> Column:
            by_shape = F.aggregate(c["f"], bias[c["c"]], lambda a, f: a + shape[F.concat(c["c"].cast("string"), f)])
            # half from the votes, half from the span's shape
            return (by_shape + vote[F.concat(c["c"].cast("string"), c["votes"])]) / 2 >= logit

        rows = rows.withColumn("cand", F.filter("cand", taken))
        # the spans of a class are in order and apart
        rows = rows.withColumns({f"__c{i}": _of_class(i) for i in range(len(CLASSES))})
        parts = [F.transform(_apart(i), partial(_kinded, KINDS.index(name))) for i, name in enumerate(CLASSES.values())]
        more = F.concat(*parts)
    else:
        more = F.expr("cast(array() as array<struct<kind: int, s: int, e: int>>)")

    def ordered(a: Column) -> Column:
        by = F.sort_array(F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("k"), x["e"].alias("e"))))
        names = F.array(*[F.lit(x) for x in KINDS])
        return F.transform(by, lambda x: F.struct(F.element_at(names, x["k"] + 1).alias("kind"), x["s"].alias("s"),
                                                  x["e"].alias("e")))

    return rows.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], ordered(F.col("base")).alias("base"),
                       ordered(F.concat("base", more)).alias("spans"))


def span_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
