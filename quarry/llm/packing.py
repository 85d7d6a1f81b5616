"""Vector bin packing of token pieces into sequences.

Every piece has a vector: tokens, segments (1) and loss-bearing tokens. A sequence has a limit for each. The
loss-bearing tokens of a document are its last ones, end id included, as in instruction data, where an answer follows
its prompt; without a column that counts them, all are. Whole sequences are cut from a long document first. The rests
wait in a pool; a sequence under construction takes the rest whose vector has the greatest dot product with what the
sequence has left, both relative to the limits; when none fits, the one with the greatest product is cut to fill the
sequence. What a partition has left at its end is dealt into sequences whose lengths are powers of two, which need no
padding, and where a limit stops a sequence earlier, into pieces of such lengths.

Null texts are empty documents (their end id alone is packed); an empty table gives no pieces; repeated rows are
packed each on its own; rests with equal products go in the order of the pool; other columns of the input are left out,
whatever they are called; very long texts are cut into whole sequences. Partitions pack on their own, so nothing is
shuffled and a lost task gives the same sequences again. Limits below 1 raise ValueError.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keeps, lean, text_of, tune
from quarry.llm.tokens import forget, sliced, tokenizer

keeps(__name__, forget)
MAX_TOKENS, MAX_SEGMENTS, POOL = 1024, 64, 256
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_FIELDS = [f.split()[0] for f in _SCHEMA.split(", ")]


class Piece:
    """Ids from start on of a document of n tokens, the last `bear` of which bear loss."""

    __slots__ = ("bear", "ids", "n", "name", "start")

    def __init__(self, name, start: int, ids: np.ndarray, n: int, bear: int):
        self.name, self.start, self.ids, self.n, self.bear = name, start, ids, n, bear

    def loss(self) -> int:
        return max(0, min(len(self.ids), self.start + len(self.ids) - (self.n - self.bear)))

    def within(self, tokens: int, loss: int) -> int:
        """How many ids from the start hold so many tokens and loss-bearing tokens at most."""
        return max(0, min(len(self.ids), tokens, max(0, self.n - self.bear - self.start) + loss))

    def cut(self, k: int) -> tuple[Piece, Piece]:
        return Piece(self.name, self.start, self.ids[:k], self.n, self.bear), Piece(self.name, self.start + k, self.ids[k:], self.n, self.bear)


class Packer:
    """add() rests; sequence() gives the pieces of one sequence."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.pool, self.tokens = pool, 0
        self.items: list[Piece] = []
        self.vectors = np.zeros((4 * pool, 3))

    def add(self, item: Piece) -> None:
        if len(self.items) == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[len(self.items)] = (len(item.ids), 1, item.loss())
        self.items.append(item)
        self.tokens += len(item.ids)

    def _take(self, k: int) -> Piece:
        item, last = self.items[k], self.items.pop()
        if k < len(self.items):
            self.items[k], self.vectors[k] = last, self.vectors[len(self.items)]
        self.tokens -= len(item.ids)
        return item

    def sequence(self) -> list[Piece]:
        """One sequence of the pool's items; the rest of a cut item goes back to the pool."""
        left, out = self.limits.copy(), []
        while self.items and left[0] > 0 and left[1] > 0:
            v = self.vectors[: len(self.items)]
            product = ((v / self.limits) * (left / self.limits)).sum(1)
            fits = (v <= left).all(1)
            if fits.any():
                item = self._take(int(np.where(fits, product, -1).argmax()))
            else:
                room = [(p, -k) for k, p in enumerate(product) if self.items[k].within(int(left[0]), int(left[2]))] if left[2] <= 0 else [(product.max(), -int(product.argmax()))]
                if not room:
                    break
                whole = self._take(-max(room)[1])
                item, rest = whole.cut(whole.within(int(left[0]), int(left[2])))
                if len(rest.ids):
                    self.add(rest)
            out.append(item)
            left -= (len(item.ids), 1, item.loss())
        return out


def powers(items: list[Piece], max_tokens: int, max_segments: int, max_loss: int):
    """Sequences of the items in their order, each as long as a power of two that they still fill within the limits."""
    items = [*reversed(items)]
    total = sum(len(i.ids) for i in items)
    while total:
        # how far the items reach within the limits decides the length
        reach, loss, count = 0, max_loss, 0
        for i in reversed(items):
            k = i.within(max_tokens - reach, loss) if count < max_segments else 0
            reach, loss, count = reach + k, loss - i.cut(k)[0].loss(), count + 1
            if k < len(i.ids):
                break
        left, out = 1 << (reach.bit_length() - 1), []
        total -= left
        while left:
            item = items.pop()
            if len(item.ids) > left:
                item, rest = item.cut(left)
                items.append(rest)
            out.append(item)
            left -= len(item.ids)
        yield out


def pack(docs: DataFrame, tokenizer_path: str, mode: str = "spaced", end_id: int = 0, doc_id: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, loss: str | None = None, pool: int = POOL) -> DataFrame:
    """One row for each piece. loss: a column with the number of loss-bearing tokens, which are the document's last.

    pool: how many rests wait at once; more fill sequences with fewer cuts and take more memory.
    """
    tune(docs.sparkSession)
    most_loss = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, most_loss, pool) < 1:
        raise ValueError("the limits of a sequence must be 1 or more")

    def run(batches):
        from pyspark import TaskContext

        tok, base, n_seq = tokenizer(tokenizer_path, mode), TaskContext.get().partitionId() << 36, 0
        end = np.asarray([end_id], "<u4")
        packer, rows = Packer(max_tokens, max_segments, most_loss, pool), []

        def emit(sequence: list[Piece]):
            nonlocal n_seq
            at = 0
            for p in sequence:
                rows.append((p.name, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.n, base + n_seq, at, p.loss()))
                at += len(p.ids)
            n_seq += bool(sequence)

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _FIELDS)
            rows.clear()
            return out

        for b in batches:
            names, texts, losses = (b.column(k).to_pylist() for k in range(3))
            for begin, stop in sliced(texts):
                for name, got, bear in zip(names[begin:stop], tok.batch(texts[begin:stop]), losses[begin:stop], strict=True):
                    ids = np.concatenate([np.frombuffer(got, "<u4"), end])
                    n = len(ids)
                    rest = Piece(name, 0, ids, n, n if bear is None else max(0, min(bear, n)))
                    while rest.within(max_tokens, most_loss) == max_tokens:
                        whole, rest = rest.cut(max_tokens)
                        emit([whole])
                    if len(rest.ids):
                        rest.ids = rest.ids.copy()
                        packer.add(rest)
                    while len(packer.items) > pool:
                        emit(packer.sequence())
                    if len(rows) > 20_000:
                        yield flushed()
        while packer.tokens >= max_tokens:
            full = packer.sequence()
            if sum(len(p.ids) for p in full) < max_tokens:  # a limit other than that of tokens: padding would follow
                for p in full:
                    packer.add(p)
                break
            emit(full)
        for sequence in powers(packer.items, max_tokens, max_segments, most_loss):
            emit(sequence)
        if rows:
            yield flushed()

    bear = F.col(f"`{loss}`").cast("long") if loss else F.lit(None).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("d"), text_of(text).alias("t"), bear.alias("l")).mapInArrow(lean(run, __name__), _SCHEMA)
