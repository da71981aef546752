"""Base spans against Python's own patterns, texts with very many matches, votes both ways."""

import random
import re
import time

from wardflow.llm import private_data

FINDERS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
           ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
           ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def fine(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(FINDERS)
                   for m in re.finditer(p, text) if fine(kind, m.group(0)))
    return [(FINDERS[k][0], s, e) for s, k, e in found]


def base(frame):
    return {r.doc_id: [(s["kind"], s["s"], s["e"]) for s in r.base] for r in frame.collect()}


def test_base_spans_of_20000_strings(spark):
    draw = random.Random(7)
    pieces = ["10.0.0.1", "127.0.0.1", "1.2.3.0", "0.0.0.0", "00.0.000.1", "256.1.1.1", "1.2.3", "255.255.255.255", "1.2.3.4.5",
              "a@b.c", "x.y@z-1.com", "@", "..", ".", "-", "+", "+44 20 7946 0958", "+1(2)", "4111 1111 1111 1111", "4111-1111",
              "5500000000000004", "0", "00", "9", "12", "é", "日", " ", "\n", "a", "Z_", "%", "(", ")", "0000 0000 0000"]
    texts = ["".join(draw.choices(pieces, k=draw.randint(1, 9))) for _ in range(20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = base(private_data.find_private(docs))
    wrong = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert wrong == []


def test_a_text_of_very_many_matches(spark):
    texts = [" ".join(f"10.0.{i % 256}.{i % 7}" for i in range(200_000)),
             " ".join(f"key=ab{i:06d}cd" for i in range(50_000)), " ".join(["a@b.cd 4111111111111111 pin: x12345"] * 20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    begun = time.time()
    got = {r.doc_id: (len(r.base), len(r.spans), r.base[-1] if r.base else None) for r in private_data.find_private(docs).collect()}
    assert time.time() - begun < 120
    assert got[0][0] == 200_000 and (got[0][2]["s"], got[0][2]["e"]) == plain(texts[0])[-1][1:]
    assert got[1][:2] == (0, 50_000) and got[2][0] == 40_000 and got[2][1] == 60_000


def test_block_borders(spark):
    """Numbers of matches around a block's size, with signs of several bytes between."""
    for n in (1, 63, 64, 65, 127, 128, 129):
        text = "é".join(f"a{i}@b.c 1.2.3.{i}" for i in range(n))
        docs = spark.createDataFrame([(n, text)], "doc_id long, text string")
        assert base(private_data.find_private(docs))[n] == plain(text), n


def test_labelers_vote_against(spark):
    texts = {"password: required for all": "short", "a path by Peter Brown Street now": "name",
             "he walked along 12 Baker Street today": "address", "the idea was born on 12 March 1980 there": "date"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = private_data.candidates(docs, "text", ["doc_id"]).collect()
    for r, (text, name) in zip(sorted(rows, key=lambda r: r["__k0"]), texts.items(), strict=True):
        mine = [c.votes for c in r.cand if c.c == list(private_data.CLASSES).index(name)]
        assert mine and all("-" in v for v in mine), (text, mine)
