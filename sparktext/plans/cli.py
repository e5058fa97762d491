"""Command line (M19): python -m sparktext.plans.cli search DIR "query"; store DIR add FILE | commit | search "query" | info | merge; compare RUN RUN QRELS."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparktext.operators import evaluate, query
from sparktext.plans.search import SearchIndex
from sparktext.sources import loaders
from sparktext.sources.store import SegmentStore


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="sparktext")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("search")
    p.add_argument("directory")
    p.add_argument("query")
    p.add_argument("--limit", type=int, default=10)
    p = commands.add_parser("store")
    p.add_argument("directory")
    p.add_argument("action", choices=["add", "remove", "commit", "merge", "info", "search"])
    p.add_argument("argument", nargs="?")
    p = commands.add_parser("compare")
    p.add_argument("baseline")
    p.add_argument("candidate")
    p.add_argument("qrels")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "search":
        page = SearchIndex(loaders.text_directory(spark, a.directory), id="id").search(a.query, a.limit)
        out = [f"{r.rank}\t{r.doc_id}\t{r.score:.6f}" for r in page.collect()]
    elif a.command == "compare":
        runs = None
        for name, path in (("baseline", a.baseline), ("candidate", a.candidate)):
            run = loaders.from_text(spark, path).withColumn("config", F.lit(name))
            runs = run if runs is None else runs.unionByName(run)
        measured = evaluate.measures(runs, loaders.qrels(spark, a.qrels))
        out = [f"{r.query_id}\t{r.delta:+.6f}\t{r.verdict}" for r in evaluate.compare(measured, "baseline", "candidate").orderBy("query_id").collect()]
    else:
        store = SegmentStore(spark, a.directory)
        out = []
        if a.action == "add":
            store.add(spark.read.schema("doc_id long, text string").json(a.argument))
        elif a.action == "remove":
            store.remove(spark.createDataFrame([(int(a.argument),)], "doc_id long"))
        elif a.action in ("commit", "merge"):
            getattr(store, a.action)()
        elif a.action == "info":
            out = [f"{k}\t{v}" for k, v in store.info().items()]
        else:
            out = [f"{r.doc_id}\t{r.score:.6f}" for r in query.search(store.index(), a.argument).orderBy(F.desc("score"), "doc_id").limit(10).collect()]
    for line in out:
        print(line)
    return out


if __name__ == "__main__":
    main()
