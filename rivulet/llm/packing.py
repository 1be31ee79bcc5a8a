"""Packing documents into fixed windows by minimum bin slack.

Each document becomes its token ids and an end id. Whole windows are cut off first. What remains of documents waits in a
pool of bounded size; each window takes the longest remainder, and a bitset subset-sum dynamic program over the pool's
lengths (with counts split in powers of two) finds the multiset that fills the rest of the window closest to capacity.
The counts are backtracked from the bitsets. If slack is left, it is closed by a cut of the longest remainder left.

Map-only: every partition of the input packs its own rows, in order, so nothing is shuffled; it wastes at most one partly
filled window. A lost task repeats with the same rows and gives the same windows.

Defined cases: null and empty texts are the end id alone; null and repeated doc_ids are kept row by row; extra columns are
ignored; an empty table gives no rows; a text of any length is cut whole, never shortened.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rivulet.llm.common import long_id, slices, text_id
from rivulet.llm.tokens import remembered

#: Rows of text at once; the encoder cuts them further by their length.
SLICE = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths out of counts whose sum is the largest that is at most room."""
    reach, steps = 1, []
    whole = (1 << (room + 1)) - 1
    for length in sorted((k for k, n in counts.items() if n and k <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            wider = (reach | reach << (length * copies)) & whole
            if wider != reach:
                steps.append((length, copies, reach))
                reach = wider
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            total -= length * copies
            chosen[length] += copies
    return chosen


class Packer:
    """Takes documents one by one and returns finished pieces; pool is the number of remainders that it keeps."""

    def __init__(self, capacity: int, pool: int, first: int = 0):
        self.capacity, self.pool, self.sequence = capacity, pool, first
        self.waiting: dict[int, list[tuple]] = defaultdict(list)  # by length: (doc, start, ids, tokens of its document)
        self.size = self.total = 0

    def _wait(self, item: tuple) -> None:
        self.waiting[len(item[2]) // 4].append(item)
        self.size += 1
        self.total += len(item[2]) // 4

    def _take(self, length: int) -> tuple:
        item = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
        self.size -= 1
        self.total -= length
        return item

    def _rows(self, items: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, tokens in items:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), tokens, self.sequence, offset, ids
            offset += n
        self.sequence += 1

    def _window(self) -> Iterator[tuple]:
        items = [self._take(max(self.waiting))]
        room = self.capacity - len(items[0][2]) // 4
        for length, n in fill({k: len(v) for k, v in self.waiting.items()}, room).items():
            items += [self._take(length) for _ in range(n)]
            room -= length * n
        if room and self.waiting:  # every length left is longer than the slack: cut one
            doc, start, ids, tokens = self._take(max(self.waiting))
            items.append((doc, start, ids[: 4 * room], tokens))
            self._wait((doc, start + room, ids[4 * room :], tokens))
        return self._rows(items)

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        tokens, at, step = len(ids) // 4, 0, 4 * self.capacity
        while len(ids) - at >= step:
            yield from self._rows([(doc, at // 4, ids[at : at + step], tokens)])
            at += step
        if at < len(ids):
            self._wait((doc, at // 4, ids[at:], tokens))
        if self.size >= self.pool:
            while self.size > self.pool // 2 and self.total >= self.capacity:
                yield from self._window()

    def end(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._window()


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, pool: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encoder = remembered(tokenizer_file)
        packer = Packer(capacity, pool, TaskContext.get().partitionId() << 33)
        names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            if not with_ids:
                return out.drop(columns="ids")
            out["ids"] = [np.frombuffer(x, "<u4").astype("int32") for x in out["ids"]]
            return out

        for batch in slices(batches, SLICE):
            rows: list[tuple] = []
            for doc, ids in zip(batch["doc_id"], encoder.encode_all(text or "" for text in batch["text"]), strict=True):
                rows += packer.add(doc, ids + end)
            if rows:
                yield frame(rows)
        if rows := list(packer.end()):
            yield frame(rows)

    schema = SCHEMA.replace("doc_id long", "doc_id string") + (", ids array<int>" if with_ids else "")
    return long_id(docs.select(text_id(), "text").mapInPandas(run, schema))
