"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, and put in the order that a model trains on.

Each text has a learned rank index over the offsets at which its lines end: straight segments, fitted so that none is off by more
than ``error`` bytes, and the residual of each offset from its segment. A cut is predicted from its rank and corrected by its
residual, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrow import at_rest, slices

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes by which a segment may miss an offset, and offsets that a segment is tried on at once.
ERROR, SPAN = 64, 512


class RankIndex:
    """Ascending offsets by rank, as error-bounded straight segments and residuals.

    A segment begins on one of the offsets; the slopes that keep all later ones within ``error`` form an interval that narrows from
    offset to offset, and where none is left the next segment begins.
    """

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        starts, slopes, at = [], [], 0
        while at < len(offsets):
            low, high, to = -np.inf, np.inf, at + 1
            while to < len(offsets):
                rise, run = offsets[to : to + SPAN] - offsets[at], np.arange(to - at, min(to + SPAN, len(offsets)) - at)
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                held = int(np.argmax(np.append(lows > highs, True)))
                if held:
                    low, high, to = lows[held - 1], highs[held - 1], to + held
                if held < len(run):
                    break
            starts.append(at)
            slopes.append((low + high) / 2 if to > at + 1 else 0.0)
            at = to
        self.starts, self.slopes = np.array(starts), np.array(slopes)
        self.bases = offsets[self.starts]
        self.residuals = (offsets - self._predicted(np.arange(len(offsets)))).astype(np.int32)

    def _predicted(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.bases[segment] + np.rint(self.slopes[segment] * (ranks - self.starts[segment])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The offsets of these ranks, exactly."""
        return self._predicted(ranks) + self.residuals[ranks]


def line_ends(text: bytes) -> np.ndarray:
    """Byte offsets before the first line and after each; a line ends with its line feed, the last also with the text."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    last = [len(text)] if text and not text.endswith(b"\n") else []
    return np.concatenate(([0], ends, last)).astype(np.int64)


def code_points(text: bytes) -> int:
    """Code points of UTF-8: all bytes but those that continue one."""
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that gave this output in this form."""
    before_prefix, before_suffix, before_middle = sentinels
    head, middle = F.substring_index(output, before_middle, 1), F.substring_index(output, before_middle, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        return F.substr(F.substring_index(head, second, 1), F.lit(len(first) + 1)), F.substring_index(head, second, -1)

    prefix, suffix = parts(before_prefix, before_suffix)
    suffix_first, prefix_last = parts(before_suffix, before_prefix)
    rebuilt = F.when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_last, middle, suffix_first))
    return F.when(form == "plain", output).otherwise(rebuilt)


def fill_in_middle(
    docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS, error: int = ERROR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per row of docs.

    n lines are cut at two ranks drawn from the first two groups of eight hex digits of the SHA-256 of seed, colon and id. The third
    group chooses rate texts in a hundred, the fourth spm_rate of these for suffix, prefix, middle (spm); the others are prefix,
    suffix, middle (psm). Empty texts, those not chosen and those that hold a sentinel are plain: the output is the text, and the
    lengths (in code points) are null.

    A null text is empty, a null id draws as one without digits. Rows that repeat an id draw alike; equal cuts leave an empty
    middle. An empty table gives no rows, other columns are not read. A text is held by one task, whole.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("h"))
    draws = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")])
    target, marks = to_arrow_schema(schema), [s.encode() for s in sentinels]

    def cut(text: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, bytes]:
        ends = line_ends(text)
        n = len(ends) - 1
        if not text or h3 % 100 >= rate or any(m in text for m in marks):
            return n, "plain", None, None, text
        a, b = RankIndex(ends, error).offsets(np.sort([h1 % (n + 1), h2 % (n + 1)])).tolist()
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        parts = ["spm", marks[1], suffix, marks[0], prefix] if h4 % 100 < spm_rate else ["psm", marks[0], prefix, marks[1], suffix]
        return n, parts[0], code_points(prefix), code_points(middle), b"".join([*parts[1:], marks[2], middle])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, *drawn = [batch.column(c) for c in ("text", "h1", "h2", "h3", "h4")]
            found = [cut(*x) for x in zip(texts.cast(pa.binary()).to_pylist(), *[d.to_pylist() for d in drawn], strict=True)]
            n, form, prefix, middle, output = zip(*found, strict=True) if found else [[]] * 5
            columns = [pa.array(c, f.type) for c, f in zip((n, form, prefix, middle), list(target)[1:5], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(output, pa.binary()).cast(target.field("output").type)], schema=target)

    return rows.select("doc_id", "text", *draws).mapInArrow(at_rest(apply), schema)
