"""Command line: build an index and answer queries."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from quarry.functions.scoring import SCORINGS
from quarry.operators.index import build_index
from quarry.operators.search import search, search_batch
from quarry.sources.readers import load_documents, prompt_queries, read_queries
from quarry.sources.writers import short_number, write_results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description="Ranked full-text search on Spark")
    p.add_argument("-d", "--data", required=True, help="folder of Parquet files (text, id)")
    p.add_argument("-a", "--algorithm", required=True, choices=["inverted", "vsm", "trigram"])
    p.add_argument("-s", "--scoring", required=True, choices=sorted(SCORINGS))
    p.add_argument("-b", "--benchmarking-mode", action="store_true", help="only build the index")
    p.add_argument("-n", "--num_results", type=int, default=10)
    p.add_argument("-q", "--queries", help="folder of .txt files, one query per line")
    p.add_argument("-l", "--latency", action="store_true", help="with -q: one query at a time, the time of each is printed")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return 1 if stop.code else 0
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    index = build_index(load_documents(spark, args.data), args.algorithm).persist()
    try:
        index.postings.count()
        if args.benchmarking_mode:
            return 0
        if args.queries:
            queries = read_queries(spark, args.queries)
            if args.latency:
                for row in queries.orderBy("query_id").toLocalIterator():
                    began = time.perf_counter_ns()
                    search(index, row["content"], args.scoring, args.num_results).collect()
                    print(f"{row['content']}: {time.perf_counter_ns() - began}")
            began = time.perf_counter_ns()
            ranked = search_batch(index, queries, args.scoring, args.num_results)
            path = write_results(ranked, args.queries, args.scoring)
            print(f"{path}: {time.perf_counter_ns() - began}")
            return 0
        for _, text in prompt_queries():
            began = time.perf_counter_ns()
            hits = search(index, text, args.scoring, args.num_results)
            lines = hits.orderBy("rank").select("doc_id", short_number(hits["score"]).alias("s")).collect()
            print(f"{text}: {time.perf_counter_ns() - began}")
            for row in lines:
                print(f"{row['doc_id']}|{row['s']}|")
        return 0
    finally:
        index.unpersist()


if __name__ == "__main__":
    sys.exit(main())
