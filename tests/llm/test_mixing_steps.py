"""The steps of the mixing model against plain loops, and what it stores on the way."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickledger.llm import context_mixing as M


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeÉ日") for _ in range(r.randint(1, 8))) for _ in range(60)]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 90))) + r.choice(["", " ", "\n"]) for _ in range(n)]


def test_symbols_are_the_lower_case_words_of_each_row():
    texts = ["", " \t ", "Ab  c", " x\n", *prose(1, 20)]
    for _, _, data, starts in M._slices(pa.array(texts)):
        symbol, row, room, tokens, owner = M.symbols(data, starts)
        want = [[M.BEFORE] * M.PAD + [b for w in t.encode().lower().split() for b in [*w, 32]] + [M.END] for t in texts]
        assert symbol.tolist() == sum(want, [])
        assert room.tolist() == [len(w) for w in want] and row.tolist() == [i for i, w in enumerate(want) for _ in w]
        words = [(i, w) for i, t in enumerate(texts) for w in t.encode().lower().split()]
        assert owner.tolist() == [i for i, _ in words]
        named = dict(zip([w for _, w in words], tokens.tolist(), strict=True))
        assert len(set(named.values())) == len(named) and [named[w] for _, w in words] == tokens.tolist()


def test_equal_places_are_looked_up_once():
    for _, _, data, starts in M._slices(pa.array(prose(2, 60) * 3)):
        symbol = M.symbols(data, starts)[0]
        found = M.contexts(symbol)
        places, times, which = M.distinct(symbol, found)
        coded = np.flatnonzero(symbol != M.BEFORE)
        same = [(symbol[i], *(c[i] for c in found)) for i in range(len(symbol))]
        assert len(places) == len({same[i] for i in coded}) < len(coded) / 3
        assert all(same[places[which[i]]] == same[i] for i in coded)
        assert (np.bincount(which[coded]) == times).all()


def test_a_code_for_each_symbol_before():
    counts = np.random.default_rng(3).integers(1, 1000, (M.BEFORE + 1, M.END + 1))
    code = M.prefix_code(counts)
    assert np.allclose((2.0 ** -code["length"]).sum(axis=1), 1)
    symbol = np.array([M.BEFORE] * M.PAD + [97, 98, 97, 32, M.END])
    begin, size = M.steps(symbol, np.arange(M.PAD, len(symbol)), code)
    for at, b, n in zip(range(M.PAD, len(symbol)), begin, size, strict=True):
        alone = M.prefix_code(counts[symbol[at - 1]])
        own = alone["begin"][symbol[at]]
        assert code["bit"][b : b + n].tolist() == alone["bit"][own : own + alone["length"][symbol[at]]].tolist()


def test_only_kept_columns_are_stored(spark):
    docs = spark.createDataFrame([(i, t, len(t), "s") for i, t in enumerate(prose(4, 30))], "doc_id bigint, text string, Size int, source string")
    rows = M.score(docs, F.col("doc_id") % 5 != 1, keep=["doc_id", "size"])
    assert rows.columns[:2] == ["doc_id", "Size"] and "text" not in rows.columns and "source" not in rows.columns
    assert "string" not in rows._jdf.queryExecution().optimizedPlan().toString() + str(rows.dtypes)
    assert "string" not in rows._jdf.queryExecution().executedPlan().toString()
    whole = {r.doc_id: r for r in M.score(docs, F.col("doc_id") % 5 != 1).collect()}
    for r in rows.collect():
        w = whole[r.doc_id]
        assert (r.Size, r.n_tokens, r.n_known) == (w.Size, w.n_tokens, w.n_known) and abs(r.bits - w.bits) < 1e-3 and w.text is not None
