"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Links join fingerprints that differ in at most ``radius`` bits. Each of the 64 bit positions gets a non-zero vector of
radius+1 bits; each non-zero vector v of that length makes one table, whose mask holds the positions with an odd inner
product with v. However r <= radius positions are chosen, some v is orthogonal to all their vectors, so a pair that
differs there agrees under v's mask: it collides in some table for certain (Pagh, 2016). Distinct fingerprints alone
enter the tables, so copies cost nothing. A bucket of moderate size is compared within one row; the members of a
crowded bucket are dealt anew by the points one flip away from them, outside the mask: two fingerprints within two
flips share such a point, and no point has more than 65 neighbours, so no pair is missed and no group grows.

Sets of shingles with a Jaccard similarity of 0.8 differ in about ten bits of 64, too many to cover: 2**(radius+1)
tables. Near copies at such a similarity are therefore proposed by samples: texts that agree in one of 24 samples of a
few shingles are compared by SimHash fingerprints of 256 bits. Each proposed link is then verified by the two sets.

The samples only spare work; what they miss is found by an exact join. In any fixed order of the shingles, two sets of a
similarity t share one of the first n - ceil(t n) + 1 of each set's n shingles (prefix filter, Chaudhuri and others, 2006),
and where they first agree at places i and j no more than min(n - i, m - j) can be common. All pairs of a cell, the sets
that hold one shingle in their prefix, are compared where these bounds and the sizes leave it open and the samples have not
joined the two. Shingles frequent in a sample of the sets come last in the order, so that cells are small; cells with the same
members are one. A set's marks are parities of its shingles' counts in some bits: bits that differ stand for different shingles that
the other set lacks, so two sets whose marks differ in more bits than the similarity allows are not proposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import at_rest, map_rows, slices
from .components import connected_components
from .shared import dropped, keyed_join, released, sieved_join, written

#: Distinct fingerprints of a bucket that are compared in one row; larger buckets are dealt by flips.
BUCKET_SIZE = 64
#: Numbers of 64 bits in a wide fingerprint; samples of a text, and shingles expected in each at least.
LANES, SAMPLES, SAMPLE = 4, 24, 4
#: Sets in which frequent shingles are counted, sets that hold a frequent one at least, frequent shingles at most.
COUNTED, FREQUENT, FREQUENTS = 10_000, 3, 200_000
#: Members of a cell that a block of the exact join holds.
BLOCK = 1000
#: Bits of a set's marks for each of its shingles at least.
MARKED = 2
#: Parts in which prefixes (by hash of the shingle), cells and proposed links (of one end) are joined one after another.
PARTS = 4
#: Members of a linked set that stand for it when the rest of a crowded cell is searched.
SPOKESMEN = 4


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The 64-bit SimHash of a text as a signed integer; 0 where it has no word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle_words, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    ones, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, n, step):  # bounded memory for very long texts
        hashes = np.array([h(joined[s:e], 42) for s, e in zip(starts[i : min(n, i + step)].tolist(), last[i : i + step].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of docs; a null text has no words, so fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        return lambda given: ((i, fingerprint(t, shingle_words)) for i, t in given)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, f"doc_id {kind}, fp long")


def masks(radius: int = 2) -> list[int]:
    """The covering masks as signed 64-bit integers: 2**(radius+1) - 1 of them, about 36 bits each for radius 2."""
    full = (1 << (radius + 1)) - 1
    vectors = [1 + i % full for i in range(64)]
    found = [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, full + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _roots(near: np.ndarray) -> np.ndarray:
    """The first member that each member of a small group reaches; near: which of them are linked."""
    root = np.arange(len(near))
    while True:  # each member takes the smallest root next to it
        low = np.where(near, root[None, :], len(near)).min(axis=1)
        if (low == root).all():
            return root
        root = low


def _trees(near: np.ndarray) -> list[tuple[int, int]]:
    """Links out of near, from each member to one next to it, that join the members of a small group as all of them would."""
    left, links = np.ones(len(near), bool), []
    for first in range(len(near)):
        if not left[first]:
            continue
        left[first], found = False, [first]
        for at in found:
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            links += [(i, at) for i in new.tolist()]
            found += new.tolist()
    return links


def _stars(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the members of a small bucket as all their links within radius would."""
    root = _roots(np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius)
    return [(int(fps[i]), int(fps[r])) for i, r in enumerate(root) if r != i]


def fingerprint_links(distinct: DataFrame, radius: int = 2, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """(a, b): links that connect distinct fingerprints exactly as all pairs within radius do. distinct: column fp."""
    if radius > 2:
        raise ValueError("crowded buckets are dealt by single flips, which cover a radius of 2 at most")
    table = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(masks(radius))])
    entries = distinct.select("fp", F.explode(table).alias("m")).select("m.t", "m.mask", F.col("fp").bitwiseAND(F.col("m.mask")).alias("cell"), "fp")
    sizes = written(entries.groupBy("t", "cell").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = written(keyed_join(entries, sizes, ["t", "cell"], "inner"), "bucket-members")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            links = [x for fps in pdf["fps"] for x in _stars(np.asarray(fps, np.int64), radius)]
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    small = shared.filter(F.col("n") <= bucket_size).groupBy("t", "cell").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    close = small.select("fps").mapInPandas(at_rest(compare), "a long, b long")

    bits = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    crowded = shared.filter(F.col("n") > bucket_size).select("t", "mask", "fp", F.explode(bits).alias("flip")).filter(F.col("flip").bitwiseAND(F.col("mask")) == 0)
    points = crowded.select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    if radius < 2:  # a shared point only tells that two are within two flips
        pairs = points.groupBy("t", "point").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)  # at most 65
        return close.unionByName(pairs.select("fps").mapInPandas(at_rest(compare), "a long, b long"))
    least = points.groupBy("t", "point").agg(F.sort_array(F.collect_set("fp")).alias("fps")).filter(F.size("fps") > 1)  # at most 65
    far = least.select(F.explode(F.slice("fps", 2, 65)).alias("a"), F.element_at("fps", 1).alias("b"))
    return close.unionByName(far)


def _named(distinct: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, n, first) of a table fp, n, first: first is now the smallest of the component. nodes: node, root of linked fps."""
    linked = distinct.join(nodes.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    linked = written(linked.withColumn("root", F.coalesce("root", "fp")), "linked")
    names = written(linked.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("members")), "names")
    return written(keyed_join(linked.drop("first"), names, ["root"], "inner", "members").select("fp", "n", "first"), "named")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Words are split at ASCII white space, with A-Z in lower case. Null and empty texts have fingerprint 0 and link
    like any other. A null id belongs to its component but never names it, unless all its ids are null. Repeated rows
    give repeated rows, an empty table an empty one; other columns are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    named = _named(distinct, connected_components(fingerprint_links(distinct.select("fp"), radius, bucket_size)))
    found = keyed_join(rows, named.withColumnRenamed("first", "component_id"), ["fp"], "left")
    return found.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """The different XXH64 values (seed 42) of a text's shingles, of all its words where they are fewer; sorted."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle_words + 1)
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(b" ".join(words[i : i + shingle_words]), 42) for i in range(n)), np.uint64, n))


#: A different odd factor for each sample.
_ODD = np.array([((2 * t + 1) * 0xD1B54A32D192ED03 ^ (t << 40)) % (1 << 64) | 1 for t in range(SAMPLES)], np.uint64)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    z = h * np.uint64(2 * lane + 1) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(29))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of LANES times 64 bits of different shingle hashes, as signed integers."""
    ones, step = np.zeros(64 * LANES, np.int64), 1 << 13
    for i in range(0, len(hashes), step):  # bounded memory for very long texts
        block = np.stack([_mixed(hashes[i : i + step], lane) for lane in range(LANES)], axis=1)
        ones += np.unpackbits(block.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def sample_cells(hashes: np.ndarray) -> list[int]:
    """One number for each sample that holds a shingle; texts with the same sample share it.

    A sample holds a shingle with probability 2**-scale, scale being such that four to eight shingles are expected. Sets
    whose similarity is 0.8 differ in size by a quarter at most, so those within a quarter of the next smaller scale
    take samples at that scale too.
    """
    if not len(hashes):
        return []
    scale = max(0, int(np.log2(len(hashes) / SAMPLE)))
    scales = [scale] + ([scale - 1] if scale and len(hashes) < 1.25 * SAMPLE * 2**scale else [])
    totals, step = np.zeros((len(scales), SAMPLES), np.uint64), 1 << 14
    for i in range(0, len(hashes), step):  # bounded memory for very long texts
        some = hashes[i : i + step]
        least, mixed = some[None, :] * _ODD[:, None], _mixed(some, 200)
        for k, s in enumerate(scales):  # the smallest products make a sample
            totals[k] += (np.where(least < np.uint64(1 << (64 - s)), mixed, np.uint64(0)) if s else mixed[None, :]).sum(axis=1, dtype=np.uint64)
    cells = [_mixed(totals[k][totals[k] > 0], 301 + s) for k, s in enumerate(scales)]
    return np.unique(np.concatenate(cells)).view(np.int64).tolist()


def digests(text: Column) -> tuple[Column, Column]:
    """Two hashes that tell texts apart, whatever their ids."""
    return F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5) -> DataFrame:
    """(doc_id, d1, d2, fp, wide, cells, shingles) for each row of docs: d1 and d2 are hashes of the text as it is, fp one of the
    whole set of shingles."""
    import xxhash

    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(given):
            for i, d1, d2, t in given:
                hashes = shingle_hashes(t, shingle_words)
                own = int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64))
                yield i, d1, d2, own, wide_fingerprint(hashes), sample_cells(hashes), hashes.view(np.int64)

        return run

    rows = docs.select(F.col(id_col).alias("doc_id"), *digests(F.col(text_col)), F.col(text_col).alias("text"))
    return map_rows(rows, make, f"doc_id {kind}, d1 long, d2 long, fp long, wide array<long>, cells array<long>, shingles array<long>")


def allowed_bits(similarity: float) -> int:
    """Bits in which the wide fingerprints of equally large sets of that similarity differ, and three standard deviations."""
    apart = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    return int(64 * LANES * apart + 3 * (64 * LANES * apart * (1 - apart)) ** 0.5)


def verified(links: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The links (a, b), a > b, between sets whose Jaccard similarity is similarity or more. sets: fp, shingles; each fp once."""
    pairs = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "proposed-links")
    found = []
    for part in range(PARTS):  # the disk holds the sets of one part of the pairs
        some = pairs.filter(F.pmod(F.xxhash64("b"), F.lit(PARTS)) == part)
        ends = written(some.select(F.col("a").alias("fp")).unionByName(some.select(F.col("b").alias("fp"))).distinct(), "linked-sets")
        asked = written(sieved_join(sets.select("fp", "shingles"), ends, "fp", "left_semi"), "asked-sets")
        released(sets.sparkSession)
        both = some.join(asked.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(asked.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
        common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sizes"))
        found.append(written(common.filter(F.col("common") + 1e-9 >= similarity * (F.col("sizes") - F.col("common"))).select("a", "b"), "verified-links"))
        for spent in (ends, asked):
            dropped(spent)
        released(sets.sparkSession)
    dropped(pairs)
    return reduce(DataFrame.unionByName, found)


def similar_links(distinct: DataFrame, similarity: float = 0.8, bucket_size: int = BUCKET_SIZE, spent: list | None = None) -> DataFrame:
    """(a, b): links between sets that share a sample and whose wide fingerprints are as close as the similarity asks.

    These are proposals, to be verified, and not all there are.

    distinct: fp, wide, cells. spent: takes the tables that can be dropped once the links are written. All members of a cell of at most bucket_size are compared. Those of a crowded cell are dealt
    into hands of about that size, by chance and anew in each cell; of each set that a hand links, SPOKESMEN members stand
    for it in the next turn, until the cell is small. A cell whose members do not halve in a turn holds unlike texts: those
    that agree in a byte of the first 64 bits, for each of its eight bytes, are compared, in hands where they are many.
    """
    most, spent = allowed_bits(similarity), [] if spent is None else spent

    def kept(df: DataFrame, name: str) -> DataFrame:
        spent.append(written(df, name))
        return spent[-1]

    entries = distinct.select(F.explode("cells").alias("cell"), "fp")
    sizes = kept(entries.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "sample-cells")
    shared = keyed_join(entries, sizes, ["cell"], "inner")  # few cells have two members: the wide fingerprints join those alone
    members = kept(shared.join(distinct.select("fp", "wide").hint("merge"), "fp").select("cell", "n", "fp", "wide"), "sample-members")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for cell, n, group in zip(pdf["cell"].tolist(), pdf["n"].tolist(), pdf["found"], strict=True):
                fps = [int(x["fp"]) for x in group]
                wide = np.array([x["wide"].tolist() for x in group], np.int64).view(np.uint64)
                near = np.bitwise_count(wide[:, None] ^ wide[None, :]).sum(axis=2, dtype=np.int64) <= most
                root = _roots(near)
                rows += [(cell, n, fps[i], fps[j], None) for i, j in _trees(near)]
                for r in np.unique(root):
                    rows += [(cell, n, fps[i], fps[i], wide[i].view(np.int64).tolist()) for i in np.flatnonzero(root == r)[:SPOKESMEN]]
            yield pd.DataFrame(rows, columns=["cell", "n", "a", "b", "wide"])

    def compared(rows: DataFrame, *keys: Column) -> DataFrame:
        """Links (a <> b), and of each set of linked members the first few (a = b), of rows with equal cells and keys."""
        named = [k.alias(f"_key{i}") for i, k in enumerate(keys)]
        groups = rows.select("cell", "n", "fp", "wide", *named).groupBy("cell", "n", *[f"_key{i}" for i in range(len(keys))])
        found = groups.agg(F.sort_array(F.collect_list(F.struct("fp", "wide"))).alias("found")).select("cell", "n", "found")
        return found.mapInPandas(at_rest(compare), "cell long, n long, a long, b long, wide array<long>")

    def links(found: DataFrame) -> DataFrame:
        return found.filter("a <> b").select("a", "b")

    def hand(*by: Column | str) -> Column:
        """The hand of about three quarters of bucket_size into which a member is dealt."""
        return F.pmod(F.xxhash64("cell", "fp", *by), F.ceil(F.col("n") * 4 / (3 * bucket_size)))

    every = [links(compared(members.filter(F.col("n") <= bucket_size)))]
    crowded, unlike, turn = members.filter(F.col("n") > bucket_size), [], 0
    while not crowded.isEmpty():
        found = kept(compared(crowded, hand(F.lit(turn))), "hands")
        left = found.filter("a = b").select("cell", F.col("n").alias("before"), F.col("a").alias("fp"), "wide")
        sizes = kept(left.groupBy("cell").agg(F.count("*").alias("n")), "hand-cells")
        left = kept(keyed_join(left, sizes, ["cell"], "inner"), "hand-members")
        many = left.filter(F.col("n") > bucket_size)
        every += [links(found), links(compared(left.filter(F.col("n") <= bucket_size)))]
        unlike.append(many.filter("2 * n > before").drop("before"))
        crowded, turn = many.filter("2 * n <= before").drop("before"), turn + 1

    parts = F.array(*[F.shiftrightunsigned(F.element_at("wide", 1), 8 * i).bitwiseAND(F.lit(255)) + F.lit(256 * i) for i in range(8)])
    for rows in unlike:
        parted = rows.select("cell", "fp", "wide", F.explode(parts).alias("part"))
        sizes = kept(parted.groupBy("cell", "part").agg(F.count("*").alias("n")).filter("n > 1"), "parts")
        shared = keyed_join(parted, sizes, ["cell", "part"], "inner")
        every.append(links(compared(shared, F.col("part"), F.when(F.col("n") > bucket_size, hand("part")).otherwise(0))))
    return reduce(DataFrame.unionByName, every)


def frequent_shingles(sets: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending as signed numbers) that many of the n sets hold, and their counts, in about COUNTED of the sets.

    They only order the shingles: the exact join finds the same pairs whatever is frequent.
    """
    some = sets.filter(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // COUNTED))) == 0)
    counts = some.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "s").limit(FREQUENTS).collect()  # two numbers each
    found = np.array(sorted((r.s, r.n) for r in rows), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def marks(hashes: np.ndarray) -> np.ndarray:
    """Parities of how many of the different hashes fall on each of some bits: at one word of 64 bits, at two, at four and so on, to
    MARKED bits a hash; level k takes the words from 2**k - 1 on.

    At any level, the bits in which two sets' marks differ are at most as many as the hashes that only one of them holds.
    """
    words = 1
    while 64 * words < MARKED * len(hashes):
        words *= 2
    place = (_mixed(hashes.view(np.uint64), 500) & np.uint64(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * words) & 1).astype(np.uint8)
    levels = [np.packbits(odd, bitorder="little").view("<i8")]
    while words > 1:
        words //= 2
        levels.append(levels[-1][:words] ^ levels[-1][words:])
    return np.concatenate(levels[::-1])


def bits_apart(x: str, y: str) -> Column:
    """Bits in which two arrays of marks differ, at the highest level that both have."""
    words = f"cast((least(size({x}), size({y})) + 1) / 2 as int)"
    return F.expr(f"aggregate(zip_with(slice({x}, {words}, {words}), slice({y}, {words}, {words}), (p, q) -> bit_count(p ^ q)), 0, (s, n) -> s + n)")


def prefixes(sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], similarity: float = 0.8) -> DataFrame:
    """(cell, fp, at, size, marks): the first shingles of each set, their places from 0, and the number of shingles in the set; the
    set's marks at place 0, none elsewhere."""
    target = pa.schema([("cell", pa.int64()), ("fp", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("marks", pa.list_(pa.int64()))])
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for batch in slices(batches):
            cells, fps, ats, sizes, marked, lengths = [], [], [], [], [], [np.zeros(1, np.int32)]
            shingles = batch.column(1)
            bounds, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy()
            for fp, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if a == b:
                    continue
                own, size = flat[a:b], b - a
                first = size - int(np.ceil(similarity * size - 1e-9)) + 1
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    often = np.where(keys[at] == own, counts[at], 0)
                    own = own[np.lexsort((own, often))]
                else:
                    own = np.sort(own)
                cells.append(own[:first])
                fps.append(np.full(first, fp, np.int64))
                ats.append(np.arange(first, dtype=np.int32))
                sizes.append(np.full(first, size, np.int32))
                marked.append(marks(own))
                lengths.append(np.zeros(first, np.int32))
                lengths[-1][0] = len(marked[-1])
            if cells:
                held = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(lengths), dtype=np.int32)), pa.array(np.concatenate(marked)))
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in (cells, fps, ats, sizes)], held], schema=target)

    return sets.select("fp", "shingles").mapInArrow(at_rest(apply), "cell long, fp long, at int, size int, marks array<long>")


def exact_pairs(sets: DataFrame, nodes: DataFrame, n: int, similarity: float = 0.8, block: int = BLOCK, spent: list | None = None) -> DataFrame:
    """(a, b): all pairs of different roots whose sets may be as similar as asked, to be verified.

    sets: fp, shingles, n rows; nodes: node, root of those already joined, whose pairs within a root are left out; spent: takes
    the tables that can be dropped once the pairs are written.
    """
    firsts = written(prefixes(sets, frequent_shingles(sets, n), similarity), "prefixes")
    held = written(firsts.filter("at = 0").select("fp", "marks"), "marks")
    # most shingles stand in one prefix alone: those go before anything is joined, a part of the shingles at a time, so that the
    # disk holds the shuffles of one part only
    parts, roots = [], nodes.withColumnRenamed("node", "fp").hint("merge")
    for part in range(PARTS):
        some = firsts.select("cell", "fp", "at", "size").filter(F.pmod(F.xxhash64("cell"), F.lit(PARTS)) == part)
        shared = written(some.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "shared-cells")
        twice = keyed_join(some, shared, ["cell"], "inner").drop("n")
        parts.append(written(twice.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted-prefixes"))
        dropped(shared)
        released(sets.sparkSession)
    dropped(firsts)
    rooted = reduce(DataFrame.unionByName, parts)
    same = F.bit_xor(F.xxhash64("fp")).alias("same")  # as cells with the same members have it; others that do only meet more
    cells = rooted.groupBy("cell").agg(F.count("*").alias("n"), same, F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    cells = written(cells.select("cell", "n", "same"), "mixed-cells")
    members = keyed_join(rooted, cells, ["cell"], "inner").groupBy("same", "n", "fp", "root", "size").agg(F.min("at").alias("at"))
    members = written(members.withColumnRenamed("same", "cell"), "cell-members")
    for done in (*parts, cells):
        dropped(done)
    released(sets.sparkSession)
    found, blocks, total = [], F.ceil(F.col("n") / block), F.col("m") + F.col("k")
    ends = (F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb"))
    open_ = ends & (F.least(F.col("m") - F.col("i"), F.col("k") - F.col("j")) + 1e-9 >= similarity / (1 + similarity) * total)
    open_ &= bits_apart("x", "y") <= (1 - similarity) / (1 + similarity) * total + 1e-6
    for part in range(PARTS):
        marked = members.filter(F.pmod(F.xxhash64("cell"), F.lit(PARTS)) == part).join(held.hint("merge"), "fp")
        marked = written(marked, "marked-members")
        x = marked.select("cell", "n", F.pmod(F.xxhash64("fp"), blocks).alias("block"), F.col("fp").alias("a"), F.col("root").alias("ra"), F.col("at").alias("i"), F.col("size").alias("m"), F.col("marks").alias("x"))
        y = marked.select("cell", "n", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.col("fp").alias("b"), F.col("root").alias("rb"), F.col("at").alias("j"), F.col("size").alias("k"), F.col("marks").alias("y"))
        found.append(written(x.join(y, ["cell", "n", "block"]).filter(open_).select("a", "b").distinct(), "open-pairs"))
        dropped(marked)
        released(sets.sparkSession)
    for done in (members, held):
        dropped(done)
    if spent is not None:
        spent += found
    return reduce(DataFrame.unionByName, found).distinct()


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, d1, d2, component_id, stays) for each row of docs whose set of shingles is nearly another's.

    Two texts link where the Jaccard similarity of their sets is as high as asked: no such pair is missed, and no other
    links. Texts without words are alike. Of a component the row with the smallest id stays, of equal ids the one with the least
    hash of its text, and rows equal in both; null ids stay only where the component has no other. Repeated rows give repeated
    rows; an empty table gives none.
    """
    rows = written(sketches(docs, id_col, text_col, shingle_words).withColumn("row", F.monotonically_increasing_id()), "sketches")
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "d1", "d2")
    distinct = written(rows.groupBy("fp").agg(F.min(own).alias("first"), F.min("row").alias("first_row"), F.count("*").alias("n")), "distinct-sketches")
    again = keyed_join(rows.select("fp", "row"), distinct.select("fp", "first_row", "n"), ["fp"], "inner").filter("row <> first_row")
    sets = sieved_join(rows, written(again.select("row"), "repeated-sets"), "row", "left_anti")
    n = distinct.count()
    spent: list[DataFrame] = []
    links = verified(similar_links(sets.select("fp", "wide", "cells"), similarity, spent=spent), sets, similarity)
    for table in spent:
        dropped(table)
    sure = connected_components(links)
    released(docs.sparkSession)
    spent = []
    more = verified(exact_pairs(sets, sure, n, similarity, spent=spent), sets, similarity)
    for table in spent:
        dropped(table)
    released(docs.sparkSession)
    nodes = connected_components(sure.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = _named(distinct.select("fp", "first", "n"), nodes)
    found = written(keyed_join(rows.select("doc_id", "d1", "d2", "fp"), named, ["fp"], "left"), "near-rows")
    dropped(rows)  # the sets of shingles are as large as the texts
    released(docs.sparkSession)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("d1") == F.col("first.d1")) & (F.col("d2") == F.col("first.d2"))
    return found.select("doc_id", "d1", "d2", F.col("first.doc_id").alias("component_id"), stays.alias("stays"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for each row of docs, as near_rows() finds them; null ids never name a component that has others."""
    return near_rows(docs, id_col, text_col, shingle_words, similarity).select("doc_id", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that near_rows() lets stay, with all their columns. Rows go by id and text together."""
    parts = near_rows(docs, id_col, text_col, shingle_words, similarity)
    gone = parts.filter("NOT stays").groupBy(F.col("doc_id").alias("_gone"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).agg(F.count("*").alias("_rows"))
    gone = written(gone.drop("_rows"), "dropped-rows")
    d1, d2 = digests(docs[text_col])
    same = docs[id_col].eqNullSafe(gone["_gone"]) & (d1 == gone["_d1"]) & (d2 == gone["_d2"])
    return docs.join(gone.hint("merge"), same, "left_anti")
