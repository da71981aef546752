"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import io
import json
import math
import struct

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from wardflow.llm import (
    context_model, decontamination, language_id, license_scan, mixing, near_dedup, private_data, quality_rules,
    token_files, toxicity, url_filter,
)
from wardflow.llm.words import words_of

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def by_text(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_token_files(spark, odd, none):
    path = token_files.shared_path(spark, "t")
    out = token_files.pack(odd, path, TOKENIZER).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r.start for r in out] == np.cumsum([0, *[r.n_tokens for r in out]])[:-1].tolist()
    assert {r.doc_id: r.n_tokens for r in out}[4] == 1
    two = token_files.read_tokens(spark, path, [8, 2]).collect()
    assert sorted(r.doc_id for r in two) == [2, 2, 8]
    assert token_files.pack(none, token_files.shared_path(spark, "t"), TOKENIZER).count() == 0


def test_shard_is_a_zstandard_file_and_reads_only_what_is_wanted():
    writer = token_files.ShardWriter("<u2", frame_tokens=10)
    texts = [np.arange(n, dtype="<u2") for n in (3, 8, 40, 0, 5)]
    parts = [p for i, t in enumerate(texts) for p in writer.add(i, t.tobytes())] + list(writer.finish())
    blob = b"".join(p + token_files.SEPARATOR for p in parts)
    reader = token_files.ShardReader(io.BytesIO(blob))
    assert [(i, t.tolist()) for _, i, t in reader.documents([2])] == [(2, texts[2].tolist())] and reader.unpacked == 1
    assert [t.tolist() for _, _, t in reader.documents()] == [t.tolist() for t in texts]
    # the public format's footer ends the file, and its table leads a plain reader to any frame
    n, flag, magic = struct.unpack("<IBI", blob[-9:])
    assert (flag, magic) == (0x80, 0x8F92EAB1)
    table = [struct.unpack_from("<III", blob, len(blob) - 9 - 12 * (n - i)) for i in range(n)]
    assert struct.unpack_from("<II", blob, len(blob) - 17 - 12 * n) == (0x184D2A5E, 12 * n + 9)
    assert sum(size for size, _, _ in table) + 17 + 12 * n == len(blob)
    at, unpacked = 0, b""
    for size, many, _ in table:
        if many:
            unpacked += zstandard.ZstdDecompressor().decompress(blob[at:at + size])
        at += size
    assert unpacked == b"".join(t.tobytes() for t in texts)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob), read_across_frames=True).read()
    assert plain == b"".join(t.tobytes() for t in texts)
    bad = bytearray(blob)
    bad[reader.frames[0][0] + 6] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.ShardReader(io.BytesIO(bytes(bad))).documents())


def test_files_that_spark_writes_are_seekable(spark, odd):
    path = token_files.shared_path(spark, "t")
    token_files.write_tokens(odd, path, TOKENIZER, shard_text=50_000)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).where("length > 0").collect()]
    assert len(files) > 1
    for blob in files:
        assert struct.unpack("<BI", blob[-5:]) == (0x80, 0x8F92EAB1)
        zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob), read_across_frames=True).read()


def test_other_tokenizers_are_used_as_they_are(spark):
    with open(TOKENIZER, encoding="utf-8") as f:
        told = f.read()
    assert token_files.encodes_words(told)
    cased = json.loads(told)
    cased["normalizer"]["normalizers"].pop()
    assert isinstance(token_files.encoder_of(json.dumps(cased)), token_files.PlainEncoder)
    for path in (public_tokenizers.path("byte_bpe_50k.json"),):
        docs = spark.createDataFrame([(1, "Two  Words here"), (2, None)], "doc_id long, text string")
        out = token_files.read_tokens(spark, _packed(spark, docs, path)).orderBy("doc_id").collect()
        plain = Tokenizer.from_file(path)
        assert [r.ids for r in out] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in ("Two  Words here", "")]


def _packed(spark, docs, tokenizer):
    path = token_files.shared_path(spark, "t")
    token_files.write_tokens(docs, path, tokenizer)
    return path


def test_encoder_equals_the_tokenizer():
    with open(TOKENIZER, encoding="utf-8") as f:
        encoder = token_files.WordEncoder(f.read(), cache_words=8)
    texts = ["don't Stop's 'tis x'll", "ABC<|endoftext|>def <|ENDOFTEXT|>", "H̱ ẖ é É.́", "ΟΔΥΣΣΕΥΣ Σ",
             "İstanbul K", "a b c\u0085d\x1ce", "über“.” «x» a.b,c 12,3 ###*** word### É,", "", "  ", "日本 ﾞ", "÷a ß,"]
    for _ in range(2):
        for text, ids in zip(texts, encoder.packed([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, encoder.dtype).tolist() == encoder.tokenizer.encode(
                text, add_special_tokens=False).ids, text


def test_url_threshold_lies_between_unseen_scores(spark):
    """Most URLs without a rule get the verdict of those they resemble."""
    rng = np.random.default_rng(6)
    good = ["".join(rng.choice(list("aeiou") + ["st", "nd", "r"], 9)) for _ in range(400)]
    bad = ["".join(rng.choice(list("xqz0189") + ["k", "7"], 9)) for _ in range(400)]
    rules = [url_filter.Rule("allow", "good.org", "/"), url_filter.Rule("block", "bad.com", "/")]
    urls = [f"http://good.org/{w}" for w in good[:200]] + [f"http://bad.com/{w}" for w in bad[:200]]
    urls += [f"http://new.net/{w}" for w in good[200:]] + [f"http://new.net/{w}" for w in bad[200:]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    model = url_filter.fit(pages, rules)
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, rules, model).collect()}
    right = sum(got[i] == ("allow" if i < 600 else "block") for i in range(400, 800))
    assert right >= 390


def test_url_filter(spark):
    rules = [url_filter.Rule("allow", "good.org", "/"), url_filter.Rule("block", "good.org", "/ads/"),
             url_filter.Rule("block", "bad.com", "/")]
    urls = [f"http://www.good.org/story/{i}" for i in range(30)] + [f"http://bad.com/pills/{i}" for i in range(30)]
    urls += ["HTTP://x.Good.ORG/ads/1?a#b", "http://notgood.org/story/1", "http://other.net/pills/77", "://", "", None, "no host"]
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], "page_id int, url string, host string, llr double")
    out = {r.url: r for r in url_filter.filter_urls(pages, rules, url_filter.fit(pages, rules)).collect()}
    ad = out["HTTP://x.Good.ORG/ads/1?a#b"]
    assert (ad.host, ad.path, ad.rule, ad.verdict) == ("x.good.org", "/ads/1", "good.org/ads/", "block")
    assert out["http://notgood.org/story/1"].rule is None and out["http://notgood.org/story/1"].verdict == "allow"
    assert out["http://other.net/pills/77"].verdict == "block"
    assert (out[None].host, out[None].path, out[None].verdict, out[""].verdict) == ("", "", "allow", "allow")
    nothing = pages.where("false")
    assert url_filter.filter_urls(nothing, rules, url_filter.fit(nothing, rules)).count() == 0


def test_toxicity(odd, none, labels, spark):
    model = toxicity.fit(odd, labels)
    out = toxicity.score_toxicity(odd, model)
    assert out.count() == 12 and out.where("score is null or score < 0 or score > 1").count() == 0
    assert out.columns.count("score") == 1
    assert toxicity.score_toxicity(none, toxicity.fit(none, labels.where("false"))).count() == 0
    bad = "you utter scum and you stupid trash loser idiot"
    clean = ["the weather of the sea and the wind over town"] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + [f"{c} {bad}" for c in clean])], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i].predicted == (i >= 40) for i in got)
    first = got[70].tox_segments[0]
    assert 8 <= first.start < first.end <= 19


def test_maximal_segments_against_all_segments():
    rng = np.random.default_rng(1)
    for _ in range(50):
        score = rng.normal(-0.2, 1, 30).round(2)
        got = toxicity.maximal_segments(np.arange(30), score, 0.0)
        best = max((score[i:j].sum() for i in range(30) for j in range(i + 1, 31)))
        if best > 0:
            assert math.isclose(max(s for _, _, s in got), best, abs_tol=1e-9)
        ends = [(s, e) for s, e, _ in got]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
        covered = {i for s, e in ends for i in range(s, e)}
        assert {i for i in range(30) if score[i] > 0} <= covered


def test_mixing(odd, none):
    out = mixing.mix(odd)
    assert out.count() == 12 and mixing.mix(none).count() == 0 and mixing.emit(none).count() == 0
    assert by_text(out, *out.columns) == by_text(mixing.mix(odd), *out.columns)
    copies = sum(r.copies for r in out.collect())
    emitted = mixing.emit(odd)
    assert emitted.columns == odd.columns and emitted.count() == copies


def test_quality_rules(odd, none):
    out = {r.doc_id: r for r in quality_rules.judge(odd).collect()}
    assert out[3].n_words == out[4].n_words == out[5].n_words == 0 and not out[3].kept and out[1].kept
    assert out[7].n_words == 30_000 and out[7].n_repeat_words == 30_000 and "repeats" in out[7].failed
    assert quality_rules.judge(none).count() == 0


def test_license_scan(spark, odd, none):
    assert license_scan.scan_licenses(odd).count() == 12 and license_scan.scan_licenses(none).count() == 0
    texts = ["x\nThis file is LICENSED under CC-BY-NC 4.0, see below", "MIT\nLicense", "Software freely redistributed",
             "Redistribution and use in source and binary forms, with or without modification, are permitted.",
             "the general public license of the mit license", None, "Kmit license KIT"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert [out[i].labels for i in range(7)] == [["cc-by-nc"], ["mit"], [], ["bsd"], ["gpl", "mit"], [], []]
    assert (out[4].n_base, out[4].first_word, out[4].last_word, out[0].score) == (2, 1, 6, 1.0)


def test_license_join_against_every_pair(spark):
    rng = np.random.default_rng(3)
    words = [w for t in license_scan.TEMPLATES for w in t.text.split()] + ["other", "text"]
    lines = [" ".join(rng.choice(words, rng.integers(2, 90))) for _ in range(300)]
    for t in license_scan.TEMPLATES:
        mine = t.text.split()
        lines += [" ".join(mine[1:]), " ".join(mine[::-1]), " ".join(["other"] * 7 + mine[:4] + ["text"] + mine[4:] + ["other"] * 9)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: set(r.labels) for r in license_scan.scan_licenses(docs, containment=0.6).collect()}

    def common(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                best[j + 1], last = (max(best[j + 1], last + 1) if x == y else max(best[j + 1], best[j])), best[j + 1]
        return best[-1]

    found = 0
    for i, line in enumerate(lines):
        every, want = line.split(), set()
        for t in license_scan.TEMPLATES:
            mine = t.text.split()
            for at in range(0, len(every), max(1, len(mine) // 2)):
                run = every[at:at + 2 * len(mine)]
                if (len(set(run) & set(mine)) >= 0.6 * len(set(mine)) - 1e-9
                        and common(mine, run) >= 0.6 * len(mine) - 1e-9):
                    want.add(t.label)
        assert got[i] | {"mit", "apache", "gpl"} == want | {"mit", "apache", "gpl"}, line
        found += len(want)
    assert found > 60


def test_scattered_and_reordered_words_are_no_license(spark):
    words = "licensed under the gnu general public license".split()
    spread = " ".join(f"{w} " + " ".join(f"y{i}" for i in range(7)) for w in words)
    texts = [spread, "all the people reserved their seats and kept the rights of way", "reserved rights all",
             " ".join(words[::-1]), "All rights are reserved", " ".join(words)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, score string")
    out = license_scan.scan_licenses(docs)
    assert out.columns.count("n_words") == out.columns.count("score") == 1
    got = {r.doc_id: (r.labels, r.score) for r in out.collect()}
    assert [got[i][0] for i in range(6)] == [[], [], [], [], ["proprietary"], ["gpl"]] and got[0][1] == 0
    spans = private_data.find_private(docs.selectExpr("doc_id", "text", "1 as base", "'x' as spans"))
    assert sorted(spans.columns) == ["base", "doc_id", "spans", "text"] and spans.count() == 6


def test_benchmarks_with_one_text_or_one_long_item(spark):
    """No block takes more than its bound, and what is found is the same."""
    long = " ".join(f"w{i % 400}q{i // 400}" for i in range(6000))
    words = long.split()
    bench = spark.createDataFrame([(f"same{i}", " ".join(words[50:75])) for i in range(3000)] + [("long", long), ("tail", long)],
                                  "item_id string, text string")
    texts = [" ".join(words[i:i + 30]) for i in range(0, 5990, 431)] + ["x " + " ".join(words[-10:]) + " y", " ".join(words[48:60]), long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks = decontamination.blocks_of(bench, max_words=2000)
    sizes = [b.selectExpr("coalesce(sum(weight), 0)").first()[0] for b in blocks]
    assert 16 < len(blocks) < 60 and max(sizes) <= 4000
    few = by_text(decontamination.find_contamination(docs, bench, max_block_words=2000), "doc_id", "items", "spans", "n_words")
    assert few == by_text(decontamination.find_contamination(docs, bench), "doc_id", "items", "spans", "n_words")
    assert all({"long", "tail"} <= set(items) for _, items, _, _ in few)


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "brown fox jumps over the lazy dog while seven wizards mix"), (1, "one two"),
                                   (2, None), (None, "34"), (3, " ")], "item_id long, text string")
    out = by_text(decontamination.find_contamination(odd, bench), "doc_id", "items")
    assert (6, [""]) in out and (8, ["1"]) in out and (9, ["1"]) in out and (3, []) in out
    split = decontamination.find_contamination(odd, bench, max_block_words=5)
    assert len(decontamination.blocks_of(bench, max_words=5)) > 1
    assert by_text(split, "doc_id", "items", "spans", "n_words") == by_text(
        decontamination.find_contamination(odd, bench), "doc_id", "items", "spans", "n_words")
    clean = decontamination.decontaminate(odd, bench)
    assert clean.columns == odd.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["3", "4", "5", "7", "None"]
    assert decontamination.find_contamination(odd, bench.where("false")).where("size(items) > 0").count() == 0
    assert decontamination.find_contamination(none, bench).count() == 0


def test_wu_manber_against_every_window():
    rng = np.random.default_rng(2)
    for m in (1, 2, 3, 10):
        text = rng.integers(0, 4 if m > 3 else 9, 3000)
        patterns = np.unique(np.concatenate([[text[i:i + m] for i in (5, 700, 2990 - m)], rng.integers(1, 9, (20, m))]), axis=0)
        start, which = decontamination.WuManber(patterns).occurrences(text)
        want = {(i, p) for i in range(3000 - m + 1) for p in range(len(patterns)) if (text[i:i + m] == patterns[p]).all()}
        assert set(zip(start.tolist(), which.tolist(), strict=True)) == want


def test_near_dedup(odd, none):
    out = by_text(near_dedup.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert (3, 0, 3, True) in out and (8, 1, 8, True) in out and (9, 1, 8, False) in out
    assert out.count((2, 17, 1, False)) == 2 and (None, 18, 1, False) in out and (None, 0, None, True) in out
    one = near_dedup.one_of_each(odd)
    assert one.columns == odd.columns
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "3", "4", "5", "6", "7", "8", "None"]
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_blocks(spark, monkeypatch):
    """Chains of near copies over many blocks: no link between components is lost."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 400)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(240):
        words = list(base)
        for j in rng.integers(0, 60, rng.integers(1, 8)):
            words[j] = f"n{i}_{j}"
        docs.append((i, " ".join(words)))
    from .test_brute_force import plain_components
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_components(frame.collect(), 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame, 3, 85).collect()}
    assert got == want and len({c for _, c in want.values()}) > 3


def test_circulant_minhash_estimates_jaccard():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    x, y = near_dedup.signature(a[:3000], 512), near_dedup.signature(a[1000:], 512)
    assert abs((x == y).mean() - 0.5) < 0.08


def test_private_data(spark, odd, none):
    assert private_data.find_private(odd).count() == 12 and private_data.find_private(none).count() == 0
    texts = ["é a@b.c..d@e.ff- x", "1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111-2 4111--1", "+1 (555) 123-4567)",
             "password=abc123def456 ok", None, "a.@b.c @d.e x@y 12345678901", "9" * 5000, "a" * 5000 + "@" + "b." * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base]
           for r in private_data.find_private(docs).selectExpr(
               "doc_id", "transform(base, x -> struct(x.kind as kind, x.s as start, x.e as end)) as base").collect()}
    assert out[0] == [("email", 2, 7), ("email", 7, 16)]
    assert out[1] == [("ip", 0, 7), ("ip", 8, 15)] and out[3] == [("phone", 0, 17)] and out[5] == []


def test_reliabilities():
    counts = {"+++": 90, "++0": 40, "+00": 10, "000": 50, "---": 200, "0--": 100, "+--": 5}
    post, prior = private_data.reliabilities(counts)
    assert post["+++"] > 0.95 and post["---"] < 0.05 and 0.1 < prior < 0.6 and post["+--"] < 0.5
    assert private_data.reliabilities({}) == ({}, 0.5)


def test_language_id(odd, none):
    model = language_id.fit(odd)
    out = {(r.doc_id, r.lang_pred) for r in language_id.identify(odd, model).collect()}
    assert (3, "und") in out and (5, "und") in out and (6, "und") in out and (1, "en") in out
    empty = language_id.fit(none)
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.count() == 7
    assert language_id.keep_identified(odd, empty).count() == 7  # nothing learned: texts with a letter
    assert language_id.keep_identified(none, model).count() == 0


def test_noise_with_letters_is_no_language(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "")]
    good = [(i, " ".join(rng.choice(words, 60)), "xx") for i in range(300)]
    noise = [(1000 + i, "".join(chr(c) for c in rng.integers(33, 127, 400)), None) for i in range(20)]
    short = [(2000, "Qz", None), (2001, "no", "xx")]
    docs = spark.createDataFrame([*good, *noise, *short], "doc_id long, text string, lang string")
    model = language_id.fit(docs.where(language_id.training_rows(docs)))
    kept = {r.doc_id for r in language_id.keep_identified(docs, model).collect()}
    assert kept == {i for i, *_ in good} | {2000, 2001}


def test_code_lengths_against_a_plain_tree(spark):
    """Exact code lengths: the automaton against a walk down the contexts of each byte."""
    order, texts = 3, ["abracadabra abracadabra", "banana bandana", "abcabcabcabc" * 60]
    rows = spark.createDataFrame([("x", t) for t in texts] + [("y", "zebra quagga")], "label string, text string")
    counts = context_model.context_counts(context_model.count_grams(rows, "label", "text", order), order, 50)
    model = context_model.Automaton(counts, order, context_model.escape_rows)
    table = {}
    for name, k, g, n in counts:
        table.setdefault((name, k, g >> 8), {})[g & 255] = n

    def prob(name, context, byte):
        k = len(context)
        below = (lambda b: prob(name, context[1:], b)) if k else (lambda b: 1 / 256)
        seen = table.get((name, k, int.from_bytes(context, "big")))
        if seen is None:
            return below(byte)
        total = sum(seen.values()) + len(seen)
        if byte in seen:
            return seen[byte] / total
        return len(seen) / total * below(byte) / (1 - sum(below(b) for b in seen))

    for text in (b"abracadabra!", b"banana \xc3\xa9", b"abc" * 400):
        got = model.code_lengths([b"", text])[1]
        full = bytes([context_model.PAD]) * order + text
        for i, name in enumerate(model.labels):
            want = -sum(math.log2(prob(name, full[j - order:j], full[j])) for j in range(order, len(full)))
            assert got[i] == pytest.approx(want, rel=1e-4)


def test_words():
    assert words_of("Ab-é 1x y\x00Z".encode()) == ["ab".encode(), "é".encode(), "1x y".encode(), b"z"]


def test_one_id_with_different_texts(spark):
    """Each text of an id is compared, and all their links are one component."""
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    rows = [(5, a), (5, b), (7, b + " more"), (8, a + " more"), (9, "quite another text " * 9), (None, a), (11, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):
        got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
        assert got == [(11, 5, False), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True), (None, 5, False)]
    many = spark.createDataFrame([(1, f"{x} " * 3 + " ".join(f"{x}{i}" for i in range(60))) for x in "abcdefgh"] + [
        (2, "a " * 3 + " ".join(f"a{i}" for i in range(60)))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(many).collect()} == {(1, 1), (2, 1)}


def test_bandings_miss_little():
    for percent in (1, 20, 30, 50, 70, 79, 80, 85, 95):
        bands, rows = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6, percent


def test_word_lists_without_stop_words_are_rejected(spark):
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)), "der Hund und die Katze im Haus " * 1 + " ".join(
        f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)), " ".join(f"слово{chr(0x430 + i % 30)}{chr(0x430 + i // 30)}" for i in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.failed) for r in quality_rules.judge(docs).collect()}
    assert got == {0: (False, ["stop_words"]), 1: (True, []), 2: (True, [])}


def test_k_fits_the_best_segments():
    """Best scores drawn from the law give its K back."""
    draw, lam, k = np.random.default_rng(2), 1.3, 0.02
    n = draw.integers(50, 2000, 4000)
    best = np.log(k * n / draw.exponential(size=4000)) / lam
    seen = best > 0
    assert 0.9 < (seen.sum() / (n * np.exp(-lam * np.maximum(best, 0))).sum()) / k < 1.1
