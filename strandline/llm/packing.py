"""Sum-of-squares online packing of token sequences into windows of a fixed capacity.

Each task packs its documents in the order they come. What a document has over whole windows goes into the fill level
for which the sum of the squared counts of partially filled windows is least afterwards (Csirik and others, 2006); the
counts are one array over the levels. Open windows are bounded: one beyond the bound is cut up to fill the fullest, and at the
end the emptiest are, so that one at most stays partly filled. That last one is cut at powers of two, the
lengths that need no padding. Nothing is shuffled, and a task that is run again packs alike.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows
from .word_tokens import word_tokens

CAPACITY = 4096
#: Open windows of a task, half as many as there are levels; their ids are all that it keeps: 32 MB at this bound.
OPEN_WINDOWS = 2048

Piece = tuple[object, int, bytes, int]  # document, start, ids, tokens of the document


class SumOfSquares:
    """Packs documents one by one; windows() drains the windows that are complete, each a list of pieces."""

    def __init__(self, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS):
        self.capacity, self.limit = capacity, open_windows
        self.counts = np.zeros(capacity + 1, np.int64)  # of partially filled windows, by fill level
        self.levels: dict[int, list[list[Piece]]] = defaultdict(list)
        self.open = 0
        self.ready: list[list[Piece]] = []

    def add(self, doc: object, ids: bytes) -> None:
        total, cap = len(ids) // 4, self.capacity
        start = 0
        while total - start >= cap:
            self.ready.append([(doc, start, ids[4 * start : 4 * (start + cap)], total)])
            start += cap
        if start < total:
            self._place((doc, start, ids[4 * start :], total))

    def _place(self, piece: Piece) -> None:
        size, n = len(piece[2]) // 4, self.counts
        # a window leaves level h and one enters h + size; at capacity it is complete and counts no more
        held = np.flatnonzero(n[1 : self.capacity - size + 1]) + 1
        best, level = (2 * int(n[size]) if size < self.capacity else 0), 0  # a new window
        if len(held):
            change = np.where(held + size < self.capacity, 2 * n[held + size] + 1, 0) - 2 * n[held]
            at = len(held) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
            if change[at] <= best:
                level = int(held[at])
        if level:
            window = self._take(level)
        else:
            window = []
        window.append(piece)
        self._put(level + size, window)
        while self.open > self.limit:
            self._merge()

    def _take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        self.open -= 1
        return self.levels[level].pop()

    def _put(self, level: int, window: list[Piece]) -> None:
        if level == self.capacity:
            self.ready.append(window)
        elif level:
            self.counts[level] += 1
            self.open += 1
            self.levels[level].append(window)

    def _merge(self) -> None:
        """Fill the fullest window with pieces cut from the emptiest; one window is open less, or complete."""
        filled = np.flatnonzero(self.counts)
        high, low = int(filled[-1]), int(filled[0])
        target = self._take(high)
        source = self._take(low)
        gap = self.capacity - high
        while gap and source:
            doc, start, ids, total = source.pop()
            keep = max(0, len(ids) // 4 - gap)
            target.append((doc, start + keep, ids[4 * keep :], total))
            gap -= len(ids) // 4 - keep
            if keep:
                source.append((doc, start, ids[: 4 * keep], total))
        self._put(self.capacity - gap, target)
        self._put(sum(len(p[2]) for p in source) // 4, source)

    def finish(self) -> None:
        while self.open > 1:
            self._merge()
        for window in [w for level in self.levels.values() for w in level]:
            left = sum(len(p[2]) for p in window) // 4
            pieces = window[::-1]
            while left:
                room = 1 << (left.bit_length() - 1)
                left -= room
                part: list[Piece] = []
                while room:
                    doc, start, ids, total = pieces.pop()
                    n = min(room, len(ids) // 4)
                    part.append((doc, start, ids[: 4 * n], total))
                    if n < len(ids) // 4:
                        pieces.append((doc, start + n, ids[4 * n :], total))
                    room -= n
                self.ready.append(part)
        self.levels.clear()
        self.counts[:] = 0
        self.open = 0

    def windows(self) -> list[list[Piece]]:
        ready, self.ready = self.ready, []
        return ready


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ids the ids.

    A document is its text's ids and end_id; a null or empty text is end_id alone. Sequences hold capacity tokens but
    for the last few of a task, whose lengths are powers of two. sequence_id counts within a task above the
    task's number. Null ids and repeated rows are packed like any other; an empty table gives no rows; other
    columns are not read. A task keeps one document and its open windows in memory.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    last = end_id.to_bytes(4, "little")

    def make():
        encoder = word_tokens(tokenizer)
        packer = SumOfSquares(capacity)
        base = TaskContext.get().partitionId() << 32

        def rows(windows: list[list[Piece]], first: int) -> Iterator[tuple]:
            for k, window in enumerate(windows):
                offset = 0
                for doc, start, part, total in window:
                    row = doc, start, len(part) // 4, zlib.crc32(part), total, base + first + k, offset
                    yield (*row, np.frombuffer(part, "<u4").astype("<i4")) if ids else row
                    offset += len(part) // 4

        def run(given: Iterator[tuple]) -> Iterator[tuple]:
            n = 0
            for doc, text in given:
                packer.add(doc, encoder.encode(text or "") + last)
                if packer.ready:
                    done = packer.windows()
                    yield from rows(done, n)
                    n += len(done)
            packer.finish()
            yield from rows(packer.windows(), n)

        return run

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids)
