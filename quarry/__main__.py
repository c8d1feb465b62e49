"""Command line: python -m quarry reindex|ingest|search|evaluate ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.config import EngineConfig, prf_options
from quarry.engine import Engine
from quarry.functions.vectors import with_vectors
from quarry.operators import dense, evaluation, feedback, index, lexical
from quarry.sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry")
    commands = parser.add_subparsers(dest="command", required=True)
    reindex = commands.add_parser("reindex", help="make all vectors anew")
    reindex.add_argument("--overwrite", action="store_true")
    commands.add_parser("ingest", help="read a folder of files").add_argument("path")
    search = commands.add_parser("search", help="BM25 over the store")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=10)
    evaluate = commands.add_parser("evaluate", help="quality over a corpus folder and a gold set")
    evaluate.add_argument("corpus")
    evaluate.add_argument("gold")
    evaluate.add_argument("--sweep", action="store_true")
    evaluate.add_argument("--out", default="results.md")
    said = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    engine = Engine(spark, EngineConfig.from_env())
    try:
        if said.command == "reindex":
            print(engine.reindex_vectors(said.overwrite))
        elif said.command == "ingest":
            for row in engine.ingest_files(said.path).toLocalIterator():
                print(f"{row['original_filename']}: {row['reason']}")
        elif said.command == "search":
            for row in engine.search_bm25(said.query, said.top_k).orderBy("rank").toLocalIterator():
                print(f"{row['rank']}. {row['title']} {row['score']:.4f}")
        else:
            evaluate_folder(spark, said.corpus, said.gold, said.out, said.sweep)
    except ValueError as bad:
        print(bad, file=sys.stderr)
        return 1
    return 0


def evaluate_folder(spark: SparkSession, corpus: str, gold: str, out: str, sweep: bool, k: int = 4, config: EngineConfig | None = None) -> dict[str, list[dict]]:
    """Writes macro figures per split and method, and the sweep if asked, into a report; returns its tables."""
    config = config or EngineConfig.from_env()
    texts = files.read_corpus(spark, corpus).withColumn("document_id", F.col("chunk_id"))
    queries, qrels = files.read_gold(spark, gold)
    built = index.build(texts, stem=config.stem)
    embedded = lambda df: with_vectors(df, "text", config.embedder, config.embedding_dims)
    near = dense.nearest(embedded(texts), embedded(queries), k).withColumn("document_id", F.col("chunk_id"))
    methods = {
        "TF-IDF": lexical.search_tfidf(queries, built, k, "exact"),
        "TF-IDF + PRF": feedback.search_with_feedback(queries, built, k, **prf_options(config), mode="exact").hits,
        "BM25": lexical.search_bm25(queries, built, k, "exact"),
        "Semantic": near,
    }
    split = evaluation.splits(queries, qrels)
    rows = [{"method": name} | r.asDict() for name, hits in methods.items() for r in evaluation.macro(evaluation.metrics(hits, qrels, queries, k, item="document_id").join(split, "query_id"), "split").collect()]
    tables = {title: [{c: v for c, v in r.items() if c != "split"} for r in rows if r["split"] == name] for name, title in evaluation.SPLITS.items()}
    ranks = evaluation.rank_positions(methods["BM25"], qrels, k, "document_id").first().asDict()
    tables["Ranks of relevant texts, BM25"] = [ranks]
    if sweep:
        cells = [r.asDict() for r in evaluation.sweep(queries, built, qrels, k, item="document_id").orderBy("k1", "b").collect()]
        tables["BM25 sweep"] = cells
        tables["Selected"] = [dict(zip(("k1", "b"), evaluation.select_parameters(cells), strict=True))]
    try:
        with open(out) as old:
            before = old.read()
    except FileNotFoundError:
        before = ""
    with open(out, "w") as new:
        new.write(evaluation.report(tables, before))
    return tables


if __name__ == "__main__":
    sys.exit(main())
