"""The pipeline against plain versions of its stages, and the registered queries against their SQL."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from tickledger.llm import queries
from test_operators import plain_dedup, plain_groups, plain_hits


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cursor.fetchall())


def test_all_queries_are_registered():
    known = entry_points.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in known} and "pipeline" in known
    assert set(entry_points.oracle_sql()) <= set(known)


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]

    def apply(name, frame):
        made = stages[name](spark, frame, sf_dir)
        rows = made.collect()
        return spark.createDataFrame(rows, made.schema), [(r.doc_id, r.text) for r in rows]

    kept, rows = apply("toxicity", docs)
    assert kept.columns == columns and set(rows) <= {(r.doc_id, r.text) for r in docs.collect()}
    groups = plain_groups(rows, 5)
    kept, rows = apply("near_duplicates", kept)
    assert Counter(i for i, _ in rows) == Counter(i for i, _, c in groups.elements() if i == c)
    plain = {i: left.decode("utf-8", "ignore") for i, _, left, _ in plain_dedup(rows)}
    kept, rows = apply("suffix_dedup", kept)
    assert kept.columns == columns and dict(rows) == plain
    hit = {i: bool(at) for i, _, at, _ in plain_hits(rows, items)}
    kept, after = apply("decontamination", kept)
    assert kept.columns == columns and Counter(after) == Counter(r for r in rows if not hit[r[0]])
    last = stages["bpe"](spark, kept, sf_dir).collect()
    assert Counter((r.doc_id, r.text) for r in last) == Counter(after) and all(r.decoded == r.text and r.n_tokens == len(r.ids) for r in last)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter(i for i, _ in after)
