"""What a task holds at once, and what a worker keeps between tasks."""

import random

import public_tokenizers
import pyarrow as pa

from strandline.llm import arrow, packing, suffix_dedup, word_tokens


def test_word_caches_go_when_another_module_has_the_worker():
    """Caches of packing serve its later tasks, and are gone when a task of another module begins."""
    path = public_tokenizers.path("word_bpe_49k.json")
    first = word_tokens.word_tokens(path)
    assert list(arrow.at_rest(iter, packing.__name__)(iter([]))) == [] and word_tokens.word_tokens(path) is first
    assert list(arrow.at_rest(lambda batches: batches)(iter([]))) == [] and not arrow.KEPT
    assert word_tokens.word_tokens(path) is not first


def test_anchors_leave_a_task_in_small_batches(spark):
    r = random.Random(61)
    docs = spark.createDataFrame([(i, "".join(chr(r.randrange(33, 127)) for _ in range(200_000)).encode()) for i in range(8)], "doc long, text binary").coalesce(1)
    sizes = suffix_dedup.anchors(docs).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
    found = [x.n for x in sizes.collect()]
    assert sum(found) > 2 * suffix_dedup.SENT_ANCHORS and max(found) <= suffix_dedup.SENT_ANCHORS
