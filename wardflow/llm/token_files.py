"""Token ids in seekable zstandard files.

A shard is a sequence of independent zstandard frames (each with its content
checksum), a document index and a trailing seek table, both in skippable
frames, so that any zstandard tool can unpack it.  The seek table is the
public seekable format's: compressed size, decompressed size and xxh64
checksum of each frame.  A document lies in one frame, whole; a reader seeks
the table, then the index, and unpacks the frames that hold the documents it wants.

Spark's text writer puts a separator after each row, so shards are written and
committed by Spark to any store, and a lost executor's shard is written anew.
The separator is the seekable format's own last four bytes: after a frame (or the index) they
are the payload of a skippable frame whose header ends the row, and after the
table they are its end, so that the file's last nine bytes are the public
format's footer.  Layout: frame, spacer, frame, spacer, ..., index, spacer, table.

Documents are range-partitioned by id into shards of about ``SHARD_TEXT``
bytes of text, in ascending order within and between shards.  A task holds
one frame and its shard's index at a time.

Defined cases: a null text is empty and holds the end id alone; null ids come
first; rows with one id stand together, ordered by the text's hash; an empty
table gives no documents.  Columns other than id and text aren't stored.
"""

from __future__ import annotations

import functools
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import cut, give_back, prepare

END_ID = 2
SHARD_TEXT = 32 << 20
FRAME_TOKENS = 1 << 16
LEVEL = 3
#: Text that a task encodes at a time.
CHUNK_TEXT = 8 << 20
#: Words whose ids a task remembers.
CACHE_WORDS = 250_000

#: The steps of a tokenizer that lower-cases, drops white space and parts words, digits and signs.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

#: Fixed values of the seekable format.
SKIPPABLE, TABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_MAGIC = 0x184D2A51
#: What follows each row, and the header that makes a skippable frame of it.
SEPARATOR = struct.pack("<I", SEEKABLE_MAGIC)
SPACER = struct.pack("<II", SKIPPABLE, len(SEPARATOR))


def skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


#: Lower-case letters of ASCII and Latin-1 in UTF-8.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
_PLAIN_BYTES = bytes([*range(97, 123), *range(0x80, 0xC0), 0xC3])
#: Kinds of bytes: 0 space, 1 ASCII letter, 2 sign, 3 anything else (digits, apostrophe, ``<``, non-ASCII).
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[97:123] = 1
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "'<"]] = 2


def parted(texts: list[bytes]) -> pa.Array:
    """The texts with a space put between letters and signs, where the tokenizer parts them anyhow.

    Only in pieces of ASCII letters, Latin-1 letters and signs; others stay as they are.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    lead = lead[(tail >= 0xA0) & (tail <= 0xBF) & (tail != 0xB7)]
    kind[lead] = 1
    kind[lead + 1] = 1
    first = np.zeros(data.size + 1, bool)  # a text's first byte starts a piece, too
    first[offsets] = True
    piece = np.cumsum((kind == 0) | first[:-1], dtype=np.int32)
    odd = np.zeros(int(piece[-1]) + 1 if piece.size else 1, bool)
    odd[piece[kind == 3]] = True
    cut = np.zeros(data.size, np.int32)
    cut[1:] = (kind[1:] + kind[:-1] == 3) & (kind[1:] > 0) & (kind[:-1] > 0) & ~first[1:-1]
    cut[odd[piece]] = 0
    moved = np.cumsum(cut, dtype=np.int32)
    out = np.full(data.size + (int(moved[-1]) if moved.size else 0), 32, np.uint8)
    out[np.arange(data.size, dtype=np.int32) + moved] = data
    ends = offsets + np.concatenate([[0], moved])[offsets]
    return pa.Array.from_buffers(pa.string(), len(texts), [
        None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


#: A special token's start, combining marks, capital sigma and dotted I: where lower-casing first could matter.
_CASED = re.compile(rb"<\||[\xcc\xcd]|\xce\xa3|\xc4\xb0")


def lowered(text: bytes) -> bytes:
    """Lower case wherever the tokenizer's own lower-casing gives the same."""
    if text.isascii():
        return text if b"<|" in text else text.lower()
    return text if _CASED.search(text) else text.decode("utf-8", "replace").lower().encode()


def _groups(texts: list[bytes], least: int = 1 << 19) -> Iterator[list[bytes]]:
    """The texts in lists of about ``least`` bytes, so that the arrays of a list stay small."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= least:
            yield part
            part, size = [], 0
    yield part


class WordEncoder:
    """Ids of whole texts, as packed integers.

    The tokenizer lower-cases, drops white space and never joins across it, so
    a text's ids are those of its space-separated pieces; equal pieces are
    encoded once while they are remembered.  A word and the stop after it are
    pieces too.  New words of plain letters are encoded many at a time: the
    last id of each is one that ends a word.
    """

    def __init__(self, tokenizer_json: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # for words of plain letters, which are normal already and single tokens before the merges
        self.plain = Tokenizer.from_str(tokenizer_json)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.half = cache_words // 2

    def forget(self) -> None:
        """Drop the remembered words, between tasks."""
        self.young, self.old = {}, {}

    def _encode(self, pieces: list[bytes]) -> Iterator[bytes]:
        for i in range(0, len(pieces), 4096):
            part = [p.decode("utf-8", "replace") for p in pieces[i:i + 4096]]
            for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                yield np.array(e.ids, self.dtype).tobytes()

    def _encode_letters(self, words: list[bytes]) -> Iterator[bytes]:
        for i in range(0, len(words), 4096):
            part = words[i:i + 4096]
            joined = b" ".join(part).decode()
            ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part):
                yield from self._encode(part)
                continue
            data, width, start = ids.tobytes(), ids.itemsize, 0
            for end in cuts:
                yield data[start * width:end * width]
                start = end

    def _learn(self, pieces: list[bytes]) -> None:
        plain = [not p.translate(None, _PLAIN_BYTES) and (p.isascii() or _PLAIN.fullmatch(p)) for p in pieces]
        words = [p for p, x in zip(pieces, plain, strict=True) if x]
        other = [p for p, x in zip(pieces, plain, strict=True) if not x]
        self.young.update(zip(words, self._encode_letters(words), strict=True))
        self.young.update(zip(other, self._encode(other), strict=True))

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pieces."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        if None in found:
            new = {pieces[i] for i, f in enumerate(found) if f is None}
            young.update((p, old[p]) for p in old.keys() & new)
            self._learn([p for p in new if p not in young])
            found = list(map(young.__getitem__, pieces))
        return found

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; equal pieces are looked up once for all of them."""
        lists = [pc.ascii_split_whitespace(parted(part)) for part in _groups([lowered(t) for t in texts])]
        counts = np.concatenate([[0], *[np.diff(x.offsets.to_numpy()) for x in lists]])
        offsets = np.cumsum(counts)
        flat = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        del lists
        which = flat.indices.to_numpy()
        ids = self._ids(flat.dictionary.cast(pa.binary()).to_pylist())
        table = np.frombuffer(b"".join(ids), self.dtype)
        width = np.dtype(self.dtype).itemsize
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // width
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        many = sizes[which]
        ends = np.cumsum(many, dtype=np.int64)
        at = np.repeat((starts[which] - (ends - many)).astype(np.int32), many)
        at += np.arange(at.size, dtype=np.int32)
        out = table[at].tobytes()
        ends = np.concatenate([[0], ends])[offsets] * width
        return [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class PlainEncoder:
    """Ids of whole texts from the tokenizer as it is, for any tokenizer."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def forget(self) -> None:
        """Nothing is remembered."""

    def packed(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]


def encodes_words(tokenizer_json: str) -> bool:
    """Whether a tokenizer is of the kind that ``WordEncoder`` takes: all steps before the merges as stated there."""
    told = json.loads(tokenizer_json)
    model = told.get("model") or {}
    return (told.get("normalizer") == WORD_NORMALIZER and told.get("pre_tokenizer") == WORD_SPLITTER
            and not told.get("truncation") and not told.get("padding")
            and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and all(a["content"].startswith("<|") and not a.get("normalized") for a in told.get("added_tokens") or []))


@functools.lru_cache(maxsize=1)
def encoder_of(tokenizer_json: str) -> WordEncoder | PlainEncoder:
    """One encoder for all tasks of a worker."""
    return (WordEncoder if encodes_words(tokenizer_json) else PlainEncoder)(tokenizer_json)


class ShardWriter:
    """Frames, then index and table, of one shard, as byte strings in order, each to be followed by SEPARATOR."""

    def __init__(self, dtype: str, level: int = LEVEL, frame_tokens: int = FRAME_TOKENS):
        self.width = np.dtype(dtype).itemsize
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frame_bytes = frame_tokens * self.width
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int, int]] = []  # id, frame, tokens
        self.held: list[bytes] = []
        self.size = self.frames = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        if self.held and self.size + len(ids) > self.frame_bytes:
            yield self._frame()
        self.held.append(ids)
        self.size += len(ids)
        self.docs.append((doc_id, self.frames, len(ids) // self.width))

    def _frame(self) -> bytes:
        data = b"".join(self.held)
        packed = self.packer.compress(data)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.table.append((len(SPACER + SEPARATOR), 0, 0))
        self.held, self.size = [], 0
        self.frames += 1
        return packed + SPACER

    def finish(self) -> Iterator[bytes]:
        if self.held:
            yield self._frame()
        if not self.docs:
            return
        ids, frames, counts = zip(*self.docs, strict=True)
        index = struct.pack("<IQ", self.width, len(ids)) + np.array([x or 0 for x in ids], "<i8").tobytes() + bytes(
            x is None for x in ids) + np.array(frames, "<u4").tobytes() + np.array(counts, "<u8").tobytes()
        block = skippable(INDEX_MAGIC, self.packer.compress(index))
        yield block + SPACER
        self.table += [(len(block), 0, 0), (len(SPACER + SEPARATOR), 0, 0)]
        rows = b"".join(struct.pack("<III", *r) for r in self.table)
        table = skippable(TABLE_MAGIC, rows + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC))
        yield table.removesuffix(SEPARATOR)


class ShardReader:
    """Random access to a shard in any seekable binary file."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        n, flag, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a seekable shard")
        rows = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        starts = np.concatenate([[0], np.cumsum(rows[:, 0].astype(np.int64))])
        # every second one is a spacer; the last of the others is the index
        self.frames = [(int(starts[i]), int(rows[i, 0]), int(rows[i, 2])) for i in range(0, n - 2, 2)]
        at = int(starts[n - 2])
        raw = zstandard.ZstdDecompressor().decompress(self._at(at + 8, int(rows[n - 2, 0]) - 8))
        self.width, many = struct.unpack_from("<IQ", raw)
        at = 12
        self.ids = np.frombuffer(raw, "<i8", many, at)
        self.null = np.frombuffer(raw, bool, many, at + 8 * many)
        self.frame = np.frombuffer(raw, "<u4", many, at + 9 * many)
        self.counts = np.frombuffer(raw, "<u8", many, at + 13 * many).astype(np.int64)
        self.unpacked = 0  # frames decompressed so far

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def _data(self, frame: int) -> bytes:
        start, size, check = self.frames[frame]
        data = zstandard.ZstdDecompressor().decompress(self._at(start, size))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"checksum of frame {frame}")
        self.unpacked += 1
        return data

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(place in the shard, id, token ids), of all documents or of those whose id is wanted."""
        pick = np.arange(self.ids.size) if wanted is None else np.flatnonzero(
            np.isin(self.ids, np.fromiter(wanted, np.int64)) & ~self.null)
        ends = np.cumsum(self.counts)
        held, data, base = -1, b"", 0
        firsts = np.searchsorted(self.frame, np.arange(len(self.frames)))
        for i in pick.tolist():
            if self.frame[i] != held:
                held = int(self.frame[i])
                data = self._data(held)
                first = firsts[held]
                base = int(ends[first] - self.counts[first])
            start = int(ends[i] - self.counts[i]) - base
            yield i, None if self.null[i] else int(self.ids[i]), np.frombuffer(
                data, f"<u{self.width}", int(self.counts[i]), start * self.width)


def chunks(batches: Iterator[pa.RecordBatch], least: int = CHUNK_TEXT) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of several batches at a time, until they hold ``least`` bytes."""
    doc_ids, texts, size = [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            doc_ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= least:
                yield doc_ids, texts
                doc_ids, texts, size = [], [], 0
    if texts:
        yield doc_ids, texts


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID,
                 shard_text: int = SHARD_TEXT) -> None:
    """Encode ``doc_id`` and ``text`` of every row into shards below ``path``."""
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary: bounded
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // shard_text))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "doc_id", F.col("text").cast("binary").alias("text"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(values: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])

        pa.set_memory_pool(pa.system_memory_pool())  # gives freed memory back between batches
        encoder = encoder_of(shared.value)
        encoder.forget()
        writer = ShardWriter(encoder.dtype)
        end = np.array([end_id], encoder.dtype).tobytes()
        for doc_ids, texts in chunks(batches):
            for doc_id, ids in zip(doc_ids, encoder.packed(texts), strict=True):
                for frame in writer.add(doc_id, ids + end):
                    yield batch([frame])
        encoder.forget()
        for frame in writer.finish():
            yield batch([frame])
        give_back()

    (rows.mapInArrow(frames, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").text(path))


def read_tokens(spark: SparkSession, path: str, wanted: list[int] | None = None, ids: bool = True) -> DataFrame:
    """(shard, place, doc_id, n_tokens, ids_crc32, ids) of all documents or the wanted ones.

    ``ids`` False leaves out the token ids.  Checksums are verified.
    """
    prepare(spark)
    fields = [T.StructField("shard", T.LongType()), T.StructField("place", T.LongType()),
              T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    schema = T.StructType(fields)
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              names=schema.names)

        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for place, doc_id, tokens in ShardReader(io.BytesIO(content.as_buffer())).documents(wanted):
                    wide = tokens.astype("<u4")
                    rows.append((shard, place, doc_id, wide.size, zlib.crc32(wide.tobytes()),
                                 *([wide.tolist()] if ids else [])))
                    if len(rows) == 1024:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    files = (spark.read.format("binaryFile").load(path).where("length > 0")
             .select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("shard"), "content"))
    return files.mapInArrow(read, schema)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write."""
    return f"{prepare(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def pack(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs``; from the files, per document: doc_id, start, n_tokens, ids_crc32, shard, place."""
    write_tokens(docs, path, tokenizer_path, end_id)
    rows = cut(read_tokens(docs.sparkSession, path, ids=False))
    # one row per shard: the window without a key sees shards, not documents
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("shard", before.alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("place")
                                               .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a shard's size is bounded, so is a window by shard
    return rows.withColumn("inside", inside).join(totals, "shard").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard", "place")
