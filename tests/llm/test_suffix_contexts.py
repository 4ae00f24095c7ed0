"""Only anchors that another document has with their context travel, and each chunk is told once about its own."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickledger.llm import suffix_dedup as D
from tickledger.llm import texts as X


def text_of(size, seed):
    draw = random.Random(seed)
    return "".join(draw.choice("abcdefgh ") for _ in range(size))


def brute(texts):
    seen, out = set(), []
    for text in (t.encode() for t in texts):
        windows = [text[i : i + D.LENGTH] for i in range(len(text) - D.LENGTH + 1)]
        gone = np.zeros(len(text), bool)
        for i, w in enumerate(windows):
            if w in seen:
                gone[i : i + D.LENGTH] = True
        seen.update(windows)
        out.append(int(gone.sum()))
    return out


def test_hashes_of_one_length():
    sums = X.prefix_sums(X.BYTE_VALUES[np.frombuffer(text_of(300, 1).encode(), np.uint8)])
    at = np.arange(300 - 20 + 1)
    assert (X.hashes_of_length(sums, 20) == X.span_hashes(sums, at, at + 20)).all()


def test_a_shared_phrase_shorter_than_the_context_makes_no_candidate():
    # an anchor of 20 bytes was enough before: such phrases sent the surroundings of every text along
    phrase = "a phrase of 28 bytes, often."
    rows = [text_of(90, i) + phrase + text_of(90, 100 + i) for i in range(50)]
    chunk = D.Chunk(pa.table({"id": list(range(50)), "text": rows}), 0, 1, True)
    assert np.unique(chunk.anchor).size < chunk.anchor.size  # equal anchors there are
    assert not chunk.prints(4)[2].any()


def test_every_place_of_an_anchor_in_a_window_is_found(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK_BYTES", 500)  # windows of exactly one match at every offset, over many chunks
    texts = []
    for i in range(60):
        base = text_of(160, i)
        texts += [base, text_of(i, 500 + i) + base[i : i + 50 + i % 3] + text_of(60 - i, 900 + i), base[i : i + 49]]
    expected = brute(texts)
    assert sum(n > 0 for n in expected) >= 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = F.expr("aggregate(removed, 0L, (n, x) -> n + (x.end - x.begin))")
    got = {r.doc_id: r.n for r in D.dedup(df).select("doc_id", size.alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_the_chunks_are_cut_into_segments_three_times_and_joined_never(spark):
    df = spark.createDataFrame([(1, "x" * 60)], "doc_id long, text string")
    plan = D.dedup(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 2 and "Join" not in plan


def test_keys_at_the_ends_of_their_range(spark, monkeypatch):
    text, keys = text_of(120, 7), [-(1 << 63), (1 << 63) - 1, 0]
    for size in (1, 4 << 20):  # in chunks of their own and in one
        monkeypatch.setattr(D, "CHUNK_BYTES", size)
        got = {r.doc_id: len(r.kept) for r in D.dedup(spark.createDataFrame([(k, text) for k in keys], "doc_id long, text string")).collect()}
        assert got == {keys[0]: 120, keys[1]: 0, keys[2]: 0}


def test_half_of_the_hash_of_an_anchor_travels():
    texts = pa.table({"id": [1, 2], "text": [text_of(120, 3)] * 2, "_chunk": [0, 0]})
    replies = pa.table({"_chunk": pa.array([], pa.int64()), "_range": pa.array([], pa.int32()), "shared": pa.array([], pa.binary())})
    made = D._surroundings(0, 1, 1)(texts, replies)
    assert made.num_rows and made.schema.field("anchor").type == pa.int32()
    assert made.column("more").to_pylist() == [1] * made.num_rows
