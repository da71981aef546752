"""Byte network, Merkle manifest and hard negatives: brute force, held-out accuracy and odd rows."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.llm import byte_network, hard_negatives, merkle, queries

SF = "/root/testdata/sf0.01"


def hexed(text):
    return sha256(text.encode()).hexdigest()


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(level, fan_out):
    """(root, proof of each leaf: its siblings' digests, and where the node stands among them)."""
    proofs, place = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, at in enumerate(place):
            low = at - at % fan_out
            run = level[low:low + fan_out]
            proofs[i].append((run[:at - low], run[at - low + 1:]))
            place[i] = at // fan_out
        level = [hexed("".join(level[i:i + fan_out])) for i in range(0, len(level), fan_out)]
    return level[0], proofs


def plain_manifest(rows, fields, later, fan_out=3):
    """doc_id -> (leaf, subroot, root, proof hash, folded root); ids are unique."""
    leaves = {r["doc_id"]: hexed("".join(plain_field(r[f]) for f in fields)) for r in rows}
    groups = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        groups.setdefault(r["source"], []).append(r["doc_id"])
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    lower = [plain_tree([leaves[i] for i in groups[s]], fan_out) for s in names]
    root, upper = plain_tree([sub for sub, _ in lower], fan_out)
    out = {}
    for name, (sub, proofs), above in zip(names, lower, upper, strict=True):
        for i, path in zip(groups[name], proofs, strict=True):
            steps, h = path + above, later.get(i, leaves[i])
            for before, after in steps:
                h = hexed("".join(before) + h + "".join(after))
            told = "".join("".join(b) + "".join(a) for b, a in steps)
            out[i] = (leaves[i], sub, root, hexed(told), h)
    return out


def test_op12(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    later = {}
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0:
            changed = d | {"text": d["text"] and d["text"].replace("\n", "")}
            later[d["doc_id"]] = hexed("".join(plain_field(changed[f]) for f in merkle.FIELDS))
    want = plain_manifest(docs, merkle.FIELDS, later)
    got = {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in
           queries.op12_merkle_manifest(spark, SF).collect()}
    assert got == want
    assert 0 < sum(w[2] != w[4] for w in want.values()) < len(want)


@pytest.mark.parametrize("fan_out", [2, 3, 5])
def test_trees_of_every_size(spark, fan_out):
    """Partitions of 1 to 14 rows, one null partition, byte order of names."""
    rows = [{"doc_id": 100 * k + i, "source": None if k == 5 else f"{'é' if k % 2 else 'z'}{k}", "text": f"t{i}"}
            for k in range(1, 15) for i in range(k)]
    frame = spark.createDataFrame([(r["doc_id"], r["source"], r["text"]) for r in rows], "doc_id long, source string, text string")
    fields = ("doc_id", "source", "text")
    want = plain_manifest(rows, fields, {}, fan_out)
    found = merkle.build(frame, fields, fan_out=fan_out)
    got = {r.doc_id: tuple(r)[1:] for r in found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof("path"), merkle.fold(F.col("leaf"), "path")).collect()}
    assert got == want and {w[4] for w in want.values()} == {w[2] for w in want.values()}


def test_manifest_odd_rows(odd, none):
    out = merkle.build(odd).select("doc_id", "source", "leaf", "subroot", "root", merkle.fold(F.col("leaf"), "path").alias("f"))
    rows = out.collect()
    assert len(rows) == 12 and {r.f for r in rows} == {r.root for r in rows} and len({r.root for r in rows}) == 1
    assert {r.leaf for r in rows if r.doc_id is None and r.source is None} == {hexed("---1:0-")}
    assert merkle.build(none).count() == 0
    lone = merkle.build(odd.where("source = 'c'")).select("leaf", "subroot", "root", merkle.proof("path").alias("p")).collect()
    assert [(r.subroot, r.root, r.p) for r in lone] == [(lone[0].leaf, lone[0].leaf, hexed(""))]


def plain_mine(rows, asked, most_positives=5, most_negatives=10):
    """Rows (id, label, whole-number vector); repeated ids are rows of their own."""
    out = []
    for a, (i, label, x) in enumerate(rows):
        if not asked(i):
            continue
        scored = sorted((-int(sum(int(p) * int(q) for p, q in zip(x, y))), j, m) for b, (j, m, y) in enumerate(rows) if b != a)
        for s, j, _ in [r for r in scored if r[2] == label][:most_positives]:
            fit = [(n, t) for t, n, m in scored if m != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, j, k + 1, n, -s, -t) for k, (n, t) in enumerate(fit[:most_negatives])]
    return sorted(out)


def test_op13(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, float)))
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op13_hard_negatives(spark, SF).collect())
    assert got == plain_mine(rows, lambda i: i % 100 == 0) and len(got) > 100


def test_many_small_blocks_give_the_same_rows(spark, monkeypatch):
    """Blocks of 16 rows, a codeword that is split, groups of 4 anchors, ties and repeated rows."""
    monkeypatch.setattr(hard_negatives, "ROW_VALUES", 16 * 6)
    monkeypatch.setattr(hard_negatives, "ANCHOR_VALUES", 4 * 6)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 8)
    draw = np.random.default_rng(3)
    vectors = [[float(v) for v in draw.normal(size=6).round(1)] for _ in range(120)] + [[0.5] * 6] * 60
    rows = [(i, int(draw.integers(0, 3)), v) for i, v in enumerate(vectors)] + [(7, 1, vectors[7])] * 2
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % 9 == 0).collect())
    plain = [(i, m, np.floor(256 * np.array(v))) for i, m, v in rows]
    assert got == plain_mine(plain, lambda i: i % 9 == 0)


def test_hard_negatives_odd_rows(spark):
    schema = "vec_id long, label int, embedding array<float>, score string"
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.5]), (3, 2, [0.5]), (4, None, [0.5, 0.5]), (5, 2, None),
            (6, 2, [nan, 0.5]), (7, 2, [0.5, None]), (8, 2, [inf, 0.0]), (9, 2, []), (None, 2, [0.5, 0.5]), (100, 5, [1.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], schema)
    got = sorted((tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % 100 == 0).collect()), key=lambda r: r[2])
    one = 2 * 256 * 256
    assert got == [(0, 1, 1, 2, one, one // 2), (0, 1, 2, None, one, one // 2), (0, 1, 3, 100, one, one // 2)] or \
        [r[3] for r in got] == [2, 100, None]
    assert hard_negatives.mine(frame, F.lit(False)).count() == 0
    assert hard_negatives.mine(frame.where("false"), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(0, 1, [3e8, 1.0]), (1, 1, [3e8, 1.0]), (2, 2, [2e8, 1.0])], "vec_id long, label int, embedding array<double>")
    scores = {(r.positive_score, r.negative_score) for r in hard_negatives.mine(huge, F.col("vec_id") == 0, scale=1.0).collect()}
    assert scores == {(9 * 10**16 + 1, 6 * 10**16 + 1)}


def test_op11(spark):
    larger = SF + "/../sf0.1"
    got = {r.doc_id: r for r in queries.op11_quality_classifier(spark, larger).collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(r.predicted, marks[i]) for i, r in got.items() if r.held_out and i in marks]
    assert np.mean([p == 1 for p, m in held if m == 1]) > 0.97
    assert np.mean([p == 0 for p, m in held if m == 0]) > 0.8


def test_network_gradient_is_the_slope_of_its_loss():
    draw = np.random.default_rng(0)
    net = byte_network.Network.start()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    net.weights["filter_bias"] += draw.normal(size=byte_network.FILTERS) * 0.1  # off the kink at 0 of padding
    texts = [bytes(draw.integers(0, 256, n).astype(np.uint8)) for n in (0, 5, 600, 1500)]
    y = np.array([0, 1, 1, 0], float)
    _, grad = byte_network.gradients(net, texts, y)
    for name, weight in net.weights.items():
        flat = weight.reshape(-1)
        for i in np.argsort(-np.abs(grad[name].reshape(-1)))[:3]:
            old, step = flat[i], 1e-6
            flat[i] = old + step
            up, _ = byte_network.gradients(net, texts, y)
            flat[i] = old - step
            down, _ = byte_network.gradients(net, texts, y)
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(grad[name].reshape(-1)[i], rel=0.02, abs=1e-5)


def test_chunks_cover_every_window_and_slabs_do_not_matter(monkeypatch):
    text = bytes(range(256)) * 23 + b"end"
    seen = set()
    parts = byte_network.chunks_of(text)
    for k, part in enumerate(parts):
        for s in range(0, byte_network.CHUNK - byte_network.WIDTH + 1, byte_network.STRIDE):
            at = k * byte_network._STEP + s
            seen.add(at)
            want = text[at:at + byte_network.WIDTH]
            assert bytes(part[s:s + len(want)].astype(np.uint8)) == want
    assert set(range(0, len(text) - byte_network.WIDTH + 1, byte_network.STRIDE)) <= seen
    assert byte_network.n_chunks(0) == byte_network.n_chunks(byte_network.CHUNK) == 1 == len(byte_network.chunks_of(b""))
    net = byte_network.Network.start()
    texts = [text, b"", text[:700], text * 3, b"x"]
    whole = net.probabilities(texts)
    monkeypatch.setattr(byte_network, "SLAB", 4)
    assert net.probabilities(texts) == pytest.approx(whole, abs=1e-5)
    assert net.probabilities(texts[::-1]) == pytest.approx(whole[::-1], abs=1e-5)


def test_quality_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, 0), (8, None), (None, 1), (99, 0)], "doc_id long, quality int")
    net = byte_network.fit(odd, labels)
    out = byte_network.score_quality(odd, net)
    assert out.count() == 12 and out.where("score is null or score < 0 or score > 1").count() == 0
    assert out.columns.count("score") == 1 and out.where("doc_id = 2").select("score").distinct().count() == 1
    assert byte_network.score_quality(none, net).count() == 0
    one = byte_network.fit(odd, labels.where("quality = 1"))
    assert one.base == pytest.approx(3 / 4) and byte_network.fit(none, labels.where("false")).base == 0.5
    assert {r.score for r in byte_network.score_quality(odd, one).collect()} == {3 / 4}
    assert {r.score for r in byte_network.score_quality(odd, byte_network.fit(none, labels)).collect()} != set()
