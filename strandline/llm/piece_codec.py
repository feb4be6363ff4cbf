"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text becomes segments, each a run of spaces and what follows it up to the next; no piece crosses their border. The
new segments of a block of texts lie end to end in flat arrays of symbols. A round looks up the piece that each
neighbouring pair would make, takes the smallest rank of each segment, and merges all its pairs of that rank at once,
leftmost first. Where a merge would bring about a pair of no larger rank while others wait, only the leftmost is made,
for the library would go on there. Finished segments leave, the arrays are compacted, and rounds go on until no pair
remains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows

#: Characters of text whose new segments are merged together.
BLOCK_CHARS = 1_000_000
#: Segments that a worker remembers in each of two generations; longer ones (in characters) are not remembered.
CACHE_SEGMENTS, CACHE_CHARS = 120_000, 48
SPACE = "▁"
SEGMENT = re.compile(" *[^ ]+| +")
NONE = np.iinfo(np.int32).max


class PieceCodec:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = pb.ModelProto.SentencePiece
        norm, trained = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not trained.byte_fallback or trained.model_type != pb.TrainerSpec.BPE:
            raise ValueError("a BPE model with byte fallback, identity normalisation and a dummy prefix is needed")
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces) or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces that are user-defined, unused or hold inner spaces are not supported")
        self.size = len(model.pieces)
        bytes_at = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.byte_ids = [bytes_at[b] for b in range(256)]
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else b"" if p.type == kind.CONTROL else " ⁇ ".encode() if p.type == kind.UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.decimal = [str(i) for i in range(self.size)]

        symbols = dict(pieces)  # of symbols that are no pieces: single characters
        for c in {c for p in pieces for c in p}:
            symbols.setdefault(c, self.size + len(symbols))
        self.chars = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        scores = sorted({model.pieces[i].score for i in pieces.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(self.size + 1, NONE, np.int32)  # the last: no piece
        for i in pieces.values():
            self.rank[i] = order[model.pieces[i].score]
        pairs = {(symbols[p[:k]] << 32) | symbols[p[k:]]: i for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self._hash(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long_run = None  # the id that long runs of spaces begin with, where they begin alike
        run = np.frombuffer(self._segments([" " * 64])[0], np.int32)
        if (run[:2] == run[0]).all():
            self.long_run = (int(run[0]), len(self.raw[run[0]]))

    # -- pairs -----------------------------------------------------------------------------------------------

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open hash table with room to spare, in two arrays."""
        self.bits = max(16, int(len(keys)).bit_length() + 3)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.size, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b make, or size."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], self.size)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    # -- rounds ----------------------------------------------------------------------------------------------

    def _segments(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment as 32-bit integers."""
        text = "".join(segments).replace(" ", SPACE)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        word = np.repeat(np.arange(len(segments)), sizes)
        sym, at = self.chars[code], np.arange(len(code))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            piece = np.full(len(sym), self.size, np.int32)
            same = word[:-1] == word[1:]
            pos = np.flatnonzero(same)
            piece[pos] = self._merged(sym[pos], sym[pos + 1])
            rank = self.rank[piece]
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            lengths = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least != NONE, lengths)
            if not live.all():
                done.append((word[~live], sym[~live], at[~live]))
                word, sym, at, piece, rank = word[live], sym[live], at[live], piece[live], rank[live]
                lengths, least = lengths[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            sel = np.flatnonzero(rank == np.repeat(least, lengths))
            run = np.concatenate(([True], np.diff(sel) != 1))  # within a run every second pair is free
            sel = sel[(np.arange(len(sel)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            sel = self._safe(sel, word, sym, piece, rank)
            sym[sel] = piece[sel]
            keep = np.ones(len(sym), bool)
            keep[sel + 1] = False
            word, sym, at = word[keep], sym[keep], at[keep]
        word, sym, at = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
        order = np.argsort(at, kind="stable")
        word, sym, at = word[order], sym[order], at[order]
        if (lost := (sym < 0) | (sym >= self.size)).any():
            word, sym = self._bytes(word, sym, at, code, lost)
        ids = sym.astype("<i4").tobytes()
        ends = np.searchsorted(word, np.arange(len(segments)), side="right") * 4
        return [ids[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)]

    def _safe(self, sel: np.ndarray, word: np.ndarray, sym: np.ndarray, piece: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of the chosen pairs, those that may merge in one round."""
        own = word[sel]
        several = np.zeros(len(sel), bool)
        several[1:] = own[1:] == own[:-1]
        several[:-1] |= several[1:].copy()
        if not several.any():
            return sel
        m = sel[several]
        new = piece[m]
        right = np.where(m + 2 < len(sym), sym[np.minimum(m + 2, len(sym) - 1)], -1)
        right[(m + 2 < len(sym)) & (word[np.minimum(m + 2, len(sym) - 1)] != word[m])] = -1
        left = np.where(m > 0, sym[np.maximum(m - 1, 0)], -1)
        left[(m > 0) & (word[np.maximum(m - 1, 0)] != word[m])] = -1
        after = np.flatnonzero(np.diff(m) == 2) + 1  # the pair before ends where this one begins
        left[after] = new[after - 1]
        worse = np.minimum(self.rank[self._merged(new, right)], self.rank[self._merged(left, new)]) <= rank[m]
        if not worse.any():
            return sel
        stop = np.isin(own, word[m[worse]])
        first = np.concatenate(([True], own[1:] != own[:-1]))
        return sel[~stop | first]

    def _bytes(self, word, sym, at, code, lost) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces, as the ids of their bytes."""
        ids = [[int(s)] if not x else [self.byte_ids[b] for b in chr(code[a]).encode("utf-8", "surrogatepass")] for s, x, a in zip(sym, lost, at, strict=True)]
        counts = [len(x) for x in ids]
        return np.repeat(word, counts), np.array([i for x in ids for i in x], np.int32)

    # -- texts -----------------------------------------------------------------------------------------------

    def _cut(self, text: str) -> list[str | int]:
        """The segments of a text, each without its first space; a number stands for so many pieces of a long run of spaces."""
        text = " " + text.replace(SPACE, " ")
        if "  " not in text and text[-1] != " ":
            return text[1:].split(" ")  # each stands for a segment with one space
        found = []
        for s in SEGMENT.findall(text):
            spaces = len(s) - len(s.lstrip(" "))
            if self.long_run and spaces > 64:  # the pieces that long runs begin with merge no further
                n, width = (spaces - 48) // self.long_run[1], self.long_run[1]
                found += [n, s[n * width + 1 :]]
            else:
                found.append(s[1:])
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library's encode without begin and end ids."""
        cut = [self._cut(t) if t else [] for t in texts]
        if len(self.young) > CACHE_SEGMENTS:
            self.young, self.old = {}, self.young
        known, old = self.young, self.old
        once: dict[str | int, bytes] = {}
        new = []
        for s in set().union(*cut).difference(known):
            if s in old:
                known[s] = old[s]
            elif isinstance(s, int):
                once[s] = np.full(s, self.long_run[0], np.int32).tobytes()
            else:
                new.append(s)
        for s, ids in zip(new, self._segments([" " + s for s in new]) if new else [], strict=True):
            (known if len(s) <= CACHE_CHARS else once)[s] = ids
        known.update(once)
        found = [np.frombuffer(b"".join(map(known.__getitem__, c)), "<i4") for c in cut]
        for s in once:
            del known[s]
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode: without the space that encode puts in front."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_loaded: dict[str, PieceCodec] = {}


def piece_codec(path: str) -> PieceCodec:
    """One codec per worker and file: what it remembers serves all the tasks that the worker runs."""
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def _blocks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    block, chars = [], 0
    for row in rows:
        block.append(row)
        chars += len(row[1] or "")
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, ids (array<int>), decoded; with texts=False their digests instead:
    n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256.

    Null and empty texts have no ids and decode to the empty text. Whole texts are encoded, in blocks of about
    BLOCK_CHARS characters; ids stay as they are, null ones too; other columns are not read; an empty table gives no
    rows.
    """
    import hashlib

    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        codec = piece_codec(model)

        def run(given: Iterator[tuple]) -> Iterator[tuple]:
            for block in _blocks(given):
                for (doc, _), ids in zip(block, codec.encode([t or "" for _, t in block]), strict=True):
                    decoded = codec.decode(ids)
                    if texts:
                        yield doc, ids, decoded
                    else:
                        listed = ",".join(map(codec.decimal.__getitem__, ids.tolist()))
                        yield doc, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return run

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, f"doc_id {kind}, ids array<int>, decoded string" if texts else f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
