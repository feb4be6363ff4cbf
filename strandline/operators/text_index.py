"""BM25 over an index in segments: lists that cannot change the best k are looked up, not read.

Documents are dealt to segments; a segment has a list of postings for each of its terms, in order of document, with the highest
impact (the part of the weight that depends on the document) as its bound. A search takes a segment's lists from the highest
bound down. Once the bounds of the lists that are left sum to less than the k-th score so far, no document outside of those
read can come among the best; of the others only those that could still pass the k-th are looked up in the lists left, which
are the long ones of common words. Each segment gives its best k, so a question costs k rows a segment in the last shuffle.

Only lists of terms that some question asks for leave the scan, each once for all questions of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import scores, text
from ..sources.kept import content_key, kept
from ..sources.tables import stored
from .retrieval import top

#: Postings of a segment, about; questions searched together; what rounding may add to a score.
POSTINGS, QUESTIONS, SLACK = 2_000_000, 2000, 2e-6


@dataclass(frozen=True)
class TextIndex:
    """lists: segment, term, docs, impacts (doc_id and impact of each posting); terms: term, df; n documents."""

    lists: DataFrame
    terms: DataFrame
    n: int


def _lengths(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("average"))


def _lists(rows: DataFrame, average: float) -> DataFrame:
    """The lists of rows (doc_id, t). A segment is what a task reads together, up to POSTINGS words; no posting is shuffled."""
    schema = "segment bigint, term string, docs array<bigint>, impacts array<double>"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            ends = np.cumsum(batch.column("t").value_lengths().to_numpy())
            cuts = np.unique(np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + POSTINGS, POSTINGS), side="right"))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                some, nth = batch.slice(a, b - a), nth + 1
                lists = some.column("t")
                sizes, coded = lists.value_lengths().to_numpy(), lists.flatten().dictionary_encode()
                ids = some.column("doc_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                place = np.empty(len(ids), np.int64)
                place[order] = np.arange(len(ids))
                cell, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(place, sizes), return_counts=True)
                term, doc = np.divmod(cell, len(ids))
                impacts = tf * (scores.K1 + 1) / (tf + scores.K1 * (1 - scores.B + scores.B * sizes[order][doc] / average))
                starts = np.flatnonzero(np.append(True, np.diff(term) != 0))
                offsets = pa.array(np.append(starts, len(term)), pa.int32())
                both = [pa.ListArray.from_arrays(offsets, pa.array(x)).cast(f.type) for x, f in zip((ids[order][doc], impacts), list(target)[2:], strict=True)]
                segment = pa.array(np.full(len(starts), (some.column("part")[0].as_py() << 32) + nth))
                yield pa.RecordBatch.from_arrays([segment, coded.dictionary.take(pa.array(term[starts])).cast(target.field("term").type), *both], schema=target)

    given = rows.filter(F.size("t") > 0).select("doc_id", "t", F.spark_partition_id().cast("long").alias("part"))
    return given.mapInArrow(apply, schema).sortWithinPartitions("segment", "term")


def build(docs: DataFrame, tokens: Callable[[Column], Column] = text.bm25_tokens, name: str = "bm25") -> TextIndex:
    """The index of docs (doc_id, text), kept by content: the same rows are indexed once.

    A null text has no terms. doc_id, a whole number, tells documents apart. Terms are cut once and no posting is shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    key = f"{name}-{content_key(rows)}"
    cut = kept(spark, f"{key}-cut", lambda: rows.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t")))
    lengths = kept(spark, f"{key}-lengths", lambda: _lengths(cut)).first()
    lists = kept(spark, f"{key}-lists", lambda: _lists(cut, max(lengths.average or 0.0, 1e-9)))
    terms = kept(spark, f"{key}-terms", lambda: lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df")))
    return TextIndex(lists, terms, lengths.n)


def best_of_segment(lists: list[tuple[float, np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the best k of a segment's ``size`` documents, and how many postings were read.

    A list is a factor, places of documents (rising) and their impacts. Ties go to the smaller place.
    """
    bounds = np.array([f * x.max() for f, _, x in lists])
    order = np.argsort(-bounds, kind="stable")
    left = np.append(np.cumsum(bounds[order][::-1])[::-1], 0.0)  # what the lists from the i-th on may add
    total, seen, read, some = np.zeros(size), np.zeros(size, bool), 0, None
    for i, t in enumerate(order.tolist()):
        factor, places, impacts = lists[t]
        if some is None and read >= k:
            kth = np.partition(total, size - k)[size - k] if size > k else 0.0
            if left[i] < kth - SLACK:
                some = np.flatnonzero(total + left[i] >= kth - SLACK)
        if some is None:
            total[places] += factor * impacts
            seen[places] = True
            read += len(places)
        else:
            at = np.minimum(np.searchsorted(places, some), len(places) - 1)
            held = places[at] == some
            total[some[held]] += factor * impacts[at[held]]
            read += min(len(some), len(places))
    some = np.flatnonzero(seen) if some is None else some
    rounded = np.round(total[some], 6)
    best = np.lexsort((some, -rounded))[:k]
    best = best[rounded[best] > 0]
    return some[best], rounded[best], read


def _asked(index: TextIndex, queries: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """query_id, term, factor: times asked and rarity of each term of a question that some document holds."""
    words = queries.select("query_id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    found = words.join(index.terms, "term")
    return found.select("query_id", "term", (F.col("times") * scores.idf(F.lit(index.n), F.col("df"))).alias("factor"))


def _of_segments(index: TextIndex, queries: DataFrame, k: int, tokens: Callable[[Column], Column]) -> DataFrame:
    """query_id, doc_id, score of each segment's best k; and a row without doc_id with postings and read of the question there.

    Questions go in groups of about QUESTIONS, whose terms and factors, and nothing else, pass through the driver.
    """
    asked = stored(_asked(index, queries, tokens), "asked")
    groups = max(1, -(-asked.select("query_id").distinct().count() // QUESTIONS))
    schema = StructType([asked.schema["query_id"], *StructType.fromDDL("doc_id bigint, score double, postings bigint, read bigint")])
    target = to_arrow_schema(schema)

    def of_group(g: int) -> DataFrame:
        mine = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        wanted: dict = {}
        for r in mine.orderBy("query_id", "term").collect():
            wanted.setdefault(r.query_id, []).append((r.term, r.factor))

        def search(segment: pa.Table) -> pa.Table:
            flat = segment.column("docs").combine_chunks()
            docs, at = np.unique(flat.flatten().to_numpy(), return_inverse=True)
            impacts = segment.column("impacts").combine_chunks().flatten().to_numpy()
            ends = np.cumsum(flat.value_lengths().to_numpy())
            held = {t: (at[a:b], impacts[a:b]) for t, a, b in zip(segment.column("term").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}
            out = []
            for query, terms in wanted.items():
                lists = [(f, *held[t]) for t, f in terms if t in held]
                if lists:
                    places, found, read = best_of_segment(lists, len(docs), k)
                    out += zip([query] * len(places), docs[places].tolist(), found.tolist(), [None] * len(places), [None] * len(places), strict=True)
                    out.append((query, None, None, sum(len(p) for _, p, _ in lists), read))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(target)
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        lists = index.lists.join(mine.select("term").distinct(), "term", "left_semi").select("segment", "term", "docs", "impacts")
        return lists.groupBy("segment").applyInArrow(search, schema)

    return reduce(DataFrame.unionByName, [of_group(g) for g in range(groups)])


def search(index: TextIndex, queries: DataFrame, k: int = 10, tokens: Callable[[Column], Column] = text.bm25_tokens) -> DataFrame:
    """query_id, doc_id, score, rank of the k best documents for each question (query_id, text), ties to the smaller doc_id.

    Only documents that share a term with the question are found; a question without such terms has no rows.
    """
    found = _of_segments(index, queries, k, tokens).filter("doc_id IS NOT NULL").select("query_id", "doc_id", "score")
    return top(found, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def postings_read(index: TextIndex, queries: DataFrame, k: int = 10, tokens: Callable[[Column], Column] = text.bm25_tokens) -> DataFrame:
    """query_id, postings, read: postings of a question's terms, and those that a search for the best k reads or looks up."""
    found = _of_segments(index, queries, k, tokens).filter("doc_id IS NULL")
    return found.groupBy("query_id").agg(F.sum("postings").alias("postings"), F.sum("read").alias("read"))
