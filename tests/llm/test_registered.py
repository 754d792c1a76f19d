"""The registered queries on the smallest shared tables, and the pipeline stage by stage."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from standcarbon.llm import decontam, near_copies, rules

from .corpus import PLAIN, awkward_rows, table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="shared tables are absent")
NUMBERS = range(1, 14)


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(NUMBERS)
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("number", [n for n in NUMBERS if n not in (2, 5, 11)])
def test_one_row_for_each_document(spark, number):
    pytest.importorskip("public_tokenizers")
    name = next(n for n in entry.queries() if n.startswith(f"op{number}_"))
    ids = Counter(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    assert Counter(r.doc_id for r in entry.queries()[name](spark, FOLDER).collect()) == ids


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    ours = entry.queries()[name](spark, FOLDER)
    theirs = connection.sql(entry.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in columns]
    left = Counter(tuple(r[c] for c in columns) for r in ours.collect())
    assert left == Counter(tuple(r[i] for i in order) for r in theirs.fetchall())


def test_pipeline_stages(spark):
    """Each stage keeps what its operator says of that stage's own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    expected = [
        lambda d: ids(rules.quality_verdicts(d, labels).filter("kept")),
        lambda d: ids(near_copies.keep_representatives(d)),
        lambda d: sorted(set(ids(d)) - set(ids(decontam.contaminated(d, benchmark)))),
    ]
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], expected, strict=True):
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns and ids(kept) == want(docs)
        docs = kept
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, FOLDER)
    assert mixed.columns == docs.columns and set(ids(mixed)) == set(ids(docs))
    placed = corpus_pipeline.STAGES[4][1](spark, mixed, FOLDER)
    assert ids(placed) == ids(mixed)
    assert corpus_pipeline.run(spark, FOLDER).count() == placed.count()


@pytest.mark.parametrize("rows", [[], awkward_rows(400)])
def test_stages_on_awkward_tables(spark, rows, tmp_path):
    docs = table(spark, rows).selectExpr(*PLAIN, "'x' as row", "'y' as _id", "'z' as component_id")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, FOLDER)
        made.write.parquet(f"{tmp_path}/{number}")
        read = spark.read.parquet(f"{tmp_path}/{number}")
        if name != "sharding":
            assert read.columns == docs.columns
        docs = read
    assert docs.count() == 0 if not rows else docs.count() > 0
