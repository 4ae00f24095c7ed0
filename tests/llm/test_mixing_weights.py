"""Whatever the mixing model learns covers all training rows, not a sample of them."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickledger.llm import context_mixing as M


def test_symbols_and_weights_cover_all_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.union(spark.createDataFrame([("",), (" \t ",), ("Straße  É x",)], "text string")).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    seen, bits = np.zeros(257, np.int64), 0
    symbol = np.concatenate([M.symbols(data, starts)[0] for _, _, data, starts in M._slices(pa.array([r.text for r in docs.collect()]))])
    seen = np.bincount(symbol[symbol != M.BEFORE], minlength=257)
    assert (M._symbol_counts(docs.select("text")) == seen).all()
    code = M.prefix_code(1 + seen)
    *halves, _ = M._tables(docs, code, 16)
    halves = [{"code": code, "width": 16, "tables": t} for t in halves]
    start = np.full((M.GATES, M.PREDICTORS + 1), 0.4, np.float32)
    weights, bits = M._learnt(docs, halves, start)
    assert bits.sum() == (seen * code["length"]).sum()
    again, _ = M._learnt(docs.repartition(7), halves, start)
    assert np.allclose(weights, again, atol=1e-5)
    # the step lowers the cost of the texts that it was made for
    cost = lambda w: sum(M.mix_bits(*M.symbols(d, s)[:3], halves[1 - h], w)[0].sum() for h in (0, 1) for _, _, d, s in M._slices(pa.array([r.text for r in docs.where(F.col("half") == h).collect()])))
    assert cost(weights) < cost(start)


def test_rows_outside_of_the_sample_change_the_weights(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    rows = [(i, " ".join(r.choice(words) for _ in range(80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    real = M._learnt
    try:
        M._learnt = lambda *a: seen.append(real(*a)) or seen[-1]
        M.score(docs, F.col("doc_id") < 50, sample=2).collect()
    finally:
        M._learnt = real
    symbols = sum(len(t) + 2 for _, t in rows[:50])
    assert seen[0][1].sum() > 2 * symbols  # several bits a symbol, over all training rows
