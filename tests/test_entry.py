import ast
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans import registry

ROOT = pathlib.Path(__file__).parents[1]
SMALL = pathlib.Path("/root/testdata/sf0.001")
FEW = ("chunk_windows", "collection_stats", "bm25_topk", "champion_diagnostics", "prf_expansion", "lexical_coverage", "retrieval_metrics", "heat_map", "dedup_sha256", "upsert_vectors", "segment_offsets", "labels_and_formats", "public_urls", "rag_contexts", "highlighted_hits")


def test_nothing_else_imports_the_corpus_operators():
    for file in (*ROOT.glob("quarry/**/*.py"), *ROOT.glob("*.py")):
        if "llm" in file.relative_to(ROOT).parts or file.name in ("corpus_pipeline.py", "__spark_entry__.py"):
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("quarry.llm", "corpus_pipeline")) for n in names), file


def test_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and registry.FLAGSHIP in queries and set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", FEW)
def test_queries_match_sql(spark, name):
    got = registry.QUERIES[name](spark, str(SMALL)).toPandas()
    db = duckdb.connect()
    for file in SMALL.glob("*.parquet"):
        db.execute(f"create view {file.stem} as select * from '{file}'")
    want = db.execute(registry.ORACLES[name]).df()[list(got.columns)]
    by = sorted(got.columns, key=lambda c: (got[c].dtype == float, c))
    got, want = (x.sort_values(by, ignore_index=True) for x in (got, want))
    assert len(got) == len(want)
    for column in got.columns:
        assert ((got[column] == want[column]) | (got[column].isna() & want[column].isna())).all(), column


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
