"""Packing of token sequences by minimum bin slack.

Every task packs the documents of its own input partition as they come, so that nothing is
shuffled and no text leaves its task. What exceeds whole windows of a document goes into a small
pool; a window is begun with the longest piece of the pool, and a subset-sum over the multiset of
remaining lengths, kept as the bits of one integer, finds the fill closest to its capacity, from
which the counts of each length are traced back. Slack that is left is filled by cutting a piece.
What a task has left at its end is cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from commonloom.llm.bpe import PATTERN, bpe, vocabulary_path
from commonloom.llm.common import arrow_slices

END = 0
#: Pieces that wait in a task's pool at most, and down to which it is worked off.
POOL, LOW = 1024, 512


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill `room` best. `lengths`: the distinct ones, ascending."""
    if room <= 0:
        return {}
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for at in range(bisect_left(lengths, room + 1) - 1, -1, -1):
        length = lengths[at]
        steps.append((length, reach))
        left, batch = min(counts[length], room // length), 1
        while left:
            batch = min(batch, left)
            reach |= (reach << (length * batch)) & mask
            left -= batch
            batch *= 2
        if reach >> room:
            break
    at, picked = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not (before >> at) & 1:
            at -= length
            n += 1
        if n:
            picked[length] = n
    return picked


class Packer:
    """Packs pieces as they come; `emit(piece, sequence, offset)` gets each once its place is known."""

    def __init__(self, capacity: int, emit: Callable[[tuple, int, int], None]) -> None:
        self.capacity, self.emit = capacity, emit
        self.pool: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.waiting = self.sequence = 0

    def _put(self, piece: tuple) -> None:
        n = len(piece[2])
        if n not in self.counts:
            insort(self.lengths, n)
            self.counts[n] = 0
        self.pool.setdefault(n, []).append(piece)
        self.counts[n] += 1
        self.waiting += 1

    def _take(self, n: int) -> tuple:
        self.counts[n] -= 1
        self.waiting -= 1
        piece = self.pool[n].pop()
        if not self.counts[n]:
            del self.counts[n], self.pool[n]
            self.lengths.pop(bisect_left(self.lengths, n))
        return piece

    def _write(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.emit(piece, self.sequence, offset)
            offset += len(piece[2])
        self.sequence += 1

    def add(self, doc: object, ids: np.ndarray) -> None:
        """A piece is (doc, start, ids)."""
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._write([(doc, start, ids[start : start + self.capacity])])
        if whole < len(ids):
            self._put((doc, whole, ids[whole:].copy()))
            if self.waiting >= POOL:
                self._work(LOW)

    def _cut(self, room: int) -> list[tuple]:
        """Pieces for exactly `room` tokens from the pool, longest first; the last is cut and its rest put back."""
        out = []
        while room:
            doc, start, ids = self._take(self.lengths[-1])
            out.append((doc, start, ids[:room]))
            if len(ids) > room:
                self._put((doc, start + room, ids[room:]))
            room -= len(out[-1][2])
        return out

    def _work(self, low: int) -> None:
        total = sum(n * c for n, c in self.counts.items())
        while self.waiting > low and total >= self.capacity:
            pieces = [self._take(self.lengths[-1])]
            room = self.capacity - len(pieces[0][2])
            for n, times in best_fill(self.lengths, self.counts, room).items():
                pieces += [self._take(n) for _ in range(times)]
                room -= n * times
            self._write(pieces + self._cut(room))
            total -= self.capacity

    def finish(self) -> None:
        self._work(0)
        total = sum(n * c for n, c in self.counts.items())
        for bit in range(total.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                self._write(self._cut(1 << bit))


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids by the merges of a byte-level vocabulary file; special tokens' strings become those tokens."""
    import tiktoken

    table = bpe(path)
    ranks = {b: i for i, b in table.bytes_of.items() if i not in table.specials.values()}
    coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=table.specials)

    def encode(text: str) -> np.ndarray:
        try:
            return coder.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its regex gives up on about a million white-space characters in a row
            return table.encode_batch([text])[0]

    return encode


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: the id, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`, and with `with_ids` the `ids`.

    A document is its text's ids and one id 0; a null or empty text is that id alone. Sequences
    hold `capacity` ids, but for a few at the end of each task whose lengths are powers of two, so
    that nothing is padded. Sequence ids are unique in the result and follow the input's
    partitions. Repeated rows and null ids are packed like all others; an empty table gives an
    empty result; other columns are not read.
    """
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()
    wide = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        packer = Packer(capacity, lambda piece, sequence, offset: rows.append((*piece, sequence, offset)))

        def flushed() -> pa.RecordBatch:
            ids = [np.ascontiguousarray(r[2], dtype="<u4") for r in rows]
            out = {
                id_col: pa.array([r[0][0] for r in rows], id_type),
                "start": np.array([r[1] for r in rows], dtype=np.int64),
                "length": np.array([len(i) for i in ids], dtype=np.int64),
                "ids_crc32": np.array([zlib.crc32(i) for i in ids], dtype=np.int64),
                "doc_tokens": np.array([r[0][1] for r in rows], dtype=np.int64),
                "sequence_id": np.array([base + r[3] for r in rows], dtype=np.int64),
                "offset": np.array([r[4] for r in rows], dtype=np.int64),
            }
            if with_ids:
                out["ids"] = pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))
            rows.clear()
            return pa.RecordBatch.from_pydict(out)

        id_type = None
        for part in arrow_slices(batches, text_col):
            id_type = part.column(id_col).type
            for doc, text in zip(part.column(id_col).to_pylist(), part.column(text_col).to_pylist(), strict=True):
                ids = np.append(encode(text) if text else np.zeros(0, dtype=np.uint32), np.uint32(END))
                packer.add((doc, len(ids)), ids)
            if rows:
                yield flushed()
        packer.finish()
        if rows:
            yield flushed()

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long{wide}"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op3(docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False)
