"""Columns of the user that are named like something an operator uses inside stay what they are."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickledger.llm import context_mixing, near_duplicates, shuffle_shards, suffix_dedup

FOLDER = Path(near_duplicates.__file__).parent
RESULTS = {
    "shuffle_shards": {"shard", "slot"},
    "suffix_dedup": {"removed", "kept"},
    "context_mixing": {"n_tokens", "n_known", "train_tokens", "base_score", "bits", "score"},
}


def internal_names(module: str) -> list[str]:
    """Every quoted word of a module's source, and the names that shielding gives."""
    found = re.findall(r"""["']([A-Za-z_][A-Za-z0-9_]*)["']""", (FOLDER / f"{module}.py").read_text())
    found += re.findall(r"(\w+) (?:bigint|int|binary|double)", (FOLDER / f"{module}.py").read_text())
    lower = {name.lower() for name in found} | {"own_key", "own_text", "own_learn", "user_0", "user_3", "_range", "lead", "anchor", "learn"}
    return sorted(lower - {"doc_id", "text"})


def with_columns(spark, names, text="text"):
    passage = " ".join(f"word{i}" for i in range(30))
    texts = [f"first {passage} end", f"other {passage} more", None, "", "short"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"doc_id long, {text} string")
    return df.select("*", *[F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names])


@pytest.mark.parametrize("module", sorted(RESULTS))
@pytest.mark.parametrize("text", ["text", "Text"])
def test_operators_keep_columns_of_any_name(spark, module, text):
    run = {
        "shuffle_shards": lambda df: shuffle_shards.shards(df, 2),
        "suffix_dedup": suffix_dedup.dedup,
        "context_mixing": lambda df: context_mixing.score(df, F.col("doc_id") != 1),
    }[module]
    names = internal_names(module)
    made = run(with_columns(spark, names, text))
    assert {text, "doc_id", *names} | RESULTS[module] == set(made.columns)
    plain = {r["doc_id"]: r for r in run(with_columns(spark, [], text)).collect()}
    rows = made.collect()
    assert len(rows) == 5
    for r in rows:
        assert all(r[n] == f"{n} of {r['doc_id']}" for n in names if n not in RESULTS[module])
        assert all(r[n] == plain[r["doc_id"]][n] for n in [text, *RESULTS[module]])


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_return_the_columns_they_get(spark, stage):
    names = ["toxicity", "removed", "kept", "_left", "hits", "items", "n_words", "_chunk", "id", "component_id", "n", "own_key", "user_2"]
    docs = with_columns(spark, names)
    made = stage[1](spark, docs, "/root/testdata/sf0.001")
    assert made.columns == docs.columns
    rows = made.collect()
    assert rows and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in names)
