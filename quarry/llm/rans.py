"""Token ids as files of range asymmetric numeral system (rANS) blocks.

All files of a data set share one static frequency table. A file holds whole documents in ascending doc_id order; its
ids are cut into independent blocks. The pass that makes the ids counts them for that table. A block interleaves LANES coders, whose states are vectors, so that one numpy step
codes LANES ids. Every CHECKPOINT_STEPS steps the decoder's states and its place among the words are stored, so that
parts of a block can be decoded by different readers, and each such part has a checksum.

File: header (MAGIC, version, blocks, ids, table's CRC), blocks, directory (an entry for each block: offset, ids, CRC
of the block's bytes), directory's offset, MAGIC. Nulls are empty texts; an empty table gives no files; rows that repeat a
doc_id stay separate documents, one after the other in no set order; a very long text fills blocks of its own file, which
then holds more than FILE_IDS ids; other columns of the input are left out, whatever they are called.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import delete, keeps, lean, text_of, tune, written
from quarry.llm.tokens import forget, sliced, tokenizer

keeps(__name__, forget)
MAGIC, VERSION = b"QRNS", 1
LANES, CHECKPOINT_STEPS, BLOCK_IDS = 2048, 64, 1 << 18
#: A file is closed at the end of the document that fills so many ids.
FILE_IDS = 1 << 20
SHIFT, LOW = np.uint64(32), np.uint64(1 << 31)
_LOW32 = np.uint64(0xFFFFFFFF)


class Frequencies:
    """Counts scaled to a power of two; every id that occurs keeps at least 1."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, counts = np.asarray(ids, "<u4")[order], np.asarray(counts, np.float64)[order]
        n = len(self.ids)
        self.bits = max(12, int(n * 4).bit_length())
        total = 1 << self.bits
        freq = 1 + np.floor(counts / max(1.0, counts.sum()) * (total - n)).astype(np.int64)
        if n:
            freq[np.argmax(freq)] += total - int(freq.sum())
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if n else np.zeros(0, np.uint64)
        self.slots = np.repeat(np.arange(n, dtype=np.uint32), freq) if n else np.zeros(0, np.uint32)
        self.crc = zlib.crc32(self.ids.tobytes() + freq.astype("<u4").tobytes())
        self.index = np.zeros(int(self.ids[-1]) + 1 if n else 0, np.uint32)
        self.index[self.ids] = np.arange(n, dtype=np.uint32)


def encode_block(ids: np.ndarray, table: Frequencies) -> bytes:
    """One block: counts, checkpoints (place among the words, states), part checksums, words."""
    n = len(ids)
    steps = -(-n // LANES)
    sym = np.zeros(steps * LANES, np.uint32)
    sym[:n] = table.index[ids]
    sym = sym.reshape(steps, LANES)
    f, c = table.freq[sym], table.cum[sym]
    bits = np.uint64(table.bits)
    limit = f << np.uint64(63 - table.bits)  # ((LOW >> bits) << 32) * f
    x = np.full(LANES, LOW, np.uint64)
    words, marks = [None] * steps, {}
    for t in range(steps - 1, -1, -1):
        over = x >= limit[t]
        words[t] = (x[over] & _LOW32).astype("<u4")
        x = np.where(over, x >> SHIFT, x)
        q = x // f[t]
        x = (q << bits) + (x - q * f[t]) + c[t]
        if t % CHECKPOINT_STEPS == 0:
            marks[t] = x
    sizes = np.array([len(w) for w in words], np.int64)
    places = np.concatenate([[0], np.cumsum(sizes)])
    parts = sorted(marks)
    crcs = [zlib.crc32(np.asarray(ids[t * LANES : (t + CHECKPOINT_STEPS) * LANES], "<u4").tobytes()) for t in parts]
    out = [struct.pack("<III", n, len(parts), int(sizes.sum()))]
    out += [struct.pack("<II", int(places[t]), k) + marks[t].astype("<u8").tobytes() for t, k in zip(parts, crcs, strict=True)]
    return b"".join([*out, *(w.tobytes() for w in words)])


def decode_block(block: bytes, table: Frequencies, part: int | None = None) -> np.ndarray:
    """The ids of the block, or of one checkpointed part of it. Raises ValueError when a checksum fails."""
    n, parts, n_words = struct.unpack_from("<III", block)
    size = 8 + 8 * LANES
    words = np.frombuffer(block, "<u4", n_words, 12 + parts * size).astype(np.uint64)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out = []
    for p in range(parts) if part is None else [part]:
        place, crc = struct.unpack_from("<II", block, 12 + p * size)
        x = np.frombuffer(block, "<u8", LANES, 20 + p * size).copy()
        first = p * CHECKPOINT_STEPS * LANES
        count = min(n - first, CHECKPOINT_STEPS * LANES)
        got = np.empty((-(-count // LANES), LANES), np.uint32)
        for t in range(len(got)):
            slot = x & mask
            s = table.slots[slot]
            got[t] = s
            x = table.freq[s] * (x >> bits) + slot - table.cum[s]
            under = np.flatnonzero(x < LOW)
            if len(under):
                x[under] = (x[under] << SHIFT) | words[place : place + len(under)]
                place += len(under)
        ids = table.ids[got.reshape(-1)[:count]]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"part {p} of a block fails its checksum")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def encode_file(ids: np.ndarray, table: Frequencies) -> bytes:
    blocks = [encode_block(ids[i : i + BLOCK_IDS], table) for i in range(0, len(ids), BLOCK_IDS)]
    head = MAGIC + struct.pack("<HIQI", VERSION, len(blocks), len(ids), table.crc)
    at, entries = len(head), []
    for b in blocks:
        entries.append(struct.pack("<QII", at, struct.unpack_from("<I", b)[0], zlib.crc32(b)))
        at += len(b)
    return b"".join([head, *blocks, *entries, struct.pack("<Q", at), MAGIC])


def decode_file(data: bytes, table: Frequencies) -> Iterator[np.ndarray]:
    """The ids of each block, in order. Raises ValueError for a damaged file or another table's file."""
    if data[:4] != MAGIC or data[-4:] != MAGIC:
        raise ValueError("not a whole file of this format")
    _, blocks, _, crc = struct.unpack_from("<HIQI", data, 4)
    if crc != table.crc:
        raise ValueError("the file belongs to another frequency table")
    (at,) = struct.unpack_from("<Q", data, len(data) - 12)
    ends = [struct.unpack_from("<QII", data, at + 16 * i) for i in range(blocks)]
    for i, (begin, _, crc) in enumerate(ends):
        block = data[begin : ends[i + 1][0] if i + 1 < blocks else at]
        if zlib.crc32(block) != crc:
            raise ValueError(f"block {i} fails its checksum")
        yield decode_block(block, table)


def _tokenised(path: str, mode: str, end_id: int, file_ids: int):
    """Sorted documents of a partition -> rows of a file's documents and ids."""
    fields = [("part", pa.int32()), ("before", pa.int64()), ("docs", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("ids", pa.binary()), ("seen", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]

    def run(batches):
        from pyspark import TaskContext

        tok, part, before = tokenizer(path, mode), TaskContext.get().partitionId(), 0
        docs, lens, ids, size = [], [], [], 0
        end = np.asarray([end_id], "<u4").tobytes()

        def row():
            raw = np.frombuffer(b"".join(ids), "<u4")
            small = raw.astype("<u2") if not len(raw) or raw.max() < 65536 else raw
            n = np.bincount(raw)
            seen = np.flatnonzero(n)
            return pa.RecordBatch.from_pydict({"part": [part], "before": [before], "docs": [docs], "lens": [lens], "ids": [bytes([small.itemsize]) + small.tobytes()], "seen": [seen], "n": [n[seen]]}, pa.schema(fields))

        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for begin, stop in sliced(texts):
                for name, got in zip(names[begin:stop], tok.batch(texts[begin:stop]), strict=True):
                    docs.append(name)
                    lens.append(len(got) // 4 + 1)
                    ids += [got, end]
                    size += lens[-1]
                    if size >= file_ids:
                        yield row()
                        docs, lens, ids, size, before = [], [], [], 0, before + size
        if docs:
            yield row()

    return run, "part int, before bigint, docs array<bigint>, lens array<bigint>, ids binary, seen array<bigint>, n array<bigint>"


def _raw(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, f"<u{cell[0]}", offset=1)


class EncodedCorpus:
    """files: part, before (ids before the file in its part), docs, lens, data; table: the shared frequencies; starts: ids before each part."""

    def __init__(self, files: DataFrame, table, starts: dict[int, int], path: str):
        self.files, self.table, self.starts, self.path = files, table, starts, path


def write_ids(docs: DataFrame, tokenizer_path: str, mode: str = "words", end_id: int = 1, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> EncodedCorpus:
    """Encode the ids of all documents into files, in ascending doc_id order (nulls first).

    One shuffle deals the texts out by ranges of doc_id. The table of counts has a row for each id of the vocabulary;
    the table of starts has a row for each partition: the driver gets no more than these two.
    """
    spark = docs.sparkSession
    tune(spark)
    run, schema = _tokenised(tokenizer_path, mode, end_id, file_ids)
    ranged = docs.select(F.col(doc_id).cast("long").alias("d"), text_of(text).alias("t")).repartitionByRange("d").sortWithinPartitions("d")
    ids, ids_path = written(ranged.mapInArrow(lean(run, __name__), schema), "ids")
    counts = ids.select(F.explode(F.arrays_zip("seen", "n")).alias("c")).groupBy(F.col("c.seen").alias("id")).agg(F.sum("c.n").alias("n")).toPandas()
    table = Frequencies(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    sums = ids.groupBy("part").agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    starts, before = {}, 0
    for part, n in sorted(map(tuple, sums)):
        starts[part], before = before, before + n
    shared = spark.sparkContext.broadcast(table)

    def encode(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                data = encode_file(_raw(one.column(4)[0].as_py()), shared.value)
                yield pa.RecordBatch.from_arrays([*one.columns[:4], pa.array([data], pa.binary())], ["part", "before", "docs", "lens", "data"])

    files, path = written(ids.drop("seen", "n").mapInArrow(lean(encode, __name__), "part int, before bigint, docs array<bigint>, lens array<bigint>, data binary"), "rans", "none")
    delete(spark, ids_path)
    return EncodedCorpus(files, shared, starts, path)


def read_digests(corpus: EncodedCorpus) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    table, starts = corpus.table, corpus.starts

    def decode(batches):
        for b in batches:
            for i in range(b.num_rows):
                part, before, docs, lens, data = (b.column(k)[i].as_py() for k in range(5))
                start = starts[part] + before
                ends = np.cumsum(lens)
                crcs, at, k, crc = [], 0, 0, 0
                for ids in decode_file(data, table.value):  # blocks follow each other: a document may go on in the next
                    raw, begin = ids.astype("<u4"), 0
                    while begin < len(raw):
                        stop = min(len(raw), begin + int(ends[k]) - at)
                        crc = zlib.crc32(raw[begin:stop].tobytes(), crc)
                        at, begin = at + stop - begin, stop
                        if at == ends[k]:
                            crcs.append(crc)
                            k, crc = k + 1, 0
                if k != len(docs):
                    raise ValueError("a file has fewer ids than its documents")
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lens, pa.int64()), pa.array(lens, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return corpus.files.select("part", "before", "docs", "lens", "data").mapInArrow(lean(decode, __name__), "doc_id long, start long, n_tokens long, ids_crc32 long")
