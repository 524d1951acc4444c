"""Command line: load RDF files into a store, query, explain, count, dump and number its terms.

    python -m trellis.cli load STORE FILE [--syntax turtle] [--rejects FOLDER]
    python -m trellis.cli query STORE 'SELECT ...' [--order dp] [--out FOLDER]
    python -m trellis.cli query STORE @query.rq
    python -m trellis.cli explain STORE '{ ... }'
    python -m trellis.cli count|dump|stats|terms STORE [--out FOLDER]
"""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trellis.engine import Engine, EngineConfig, row_text, write_rows
from trellis.operators.dictionary import build_dictionary
from trellis.plans.parser import parse_bgp
from trellis.session import configure
from trellis.sources.rdf import load
from trellis.sources.store import TripleStore


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="trellis", description=__doc__.splitlines()[0])
    p.add_argument("verb", choices=["load", "query", "explain", "count", "dump", "stats", "terms"])
    p.add_argument("store")
    p.add_argument("text", nargs="?", default="")
    p.add_argument("--syntax")
    p.add_argument("--order", default="connected")
    p.add_argument("--out", help="folder for the rows, instead of printing them")
    p.add_argument("--rejects", help="folder for what could not be read in a load, as Parquet")
    p.add_argument("--rows", type=int, help="print no more rows than this; without it all are printed")
    a = p.parse_args(args)
    if a.text.startswith("@"):
        a.text = Path(a.text[1:]).read_text()
    spark = spark or configure(SparkSession.builder.appName("trellis")).getOrCreate()
    if a.verb == "load":
        began = time.perf_counter()
        loaded = load(spark, a.text, a.syntax)
        loaded.store.write(a.store, mode="overwrite")
        n, took = TripleStore.read(spark, a.store).size(), time.perf_counter() - began
        bad = loaded.report().agg(F.coalesce(F.sum("n_rejects"), F.lit(0))).first()[0]
        if a.rejects:
            loaded.rejects.write.mode("overwrite").parquet(a.rejects)
        print(f"{n} triples in {took:.1f} s, {n / took:.0f} a second; {bad} rejected")
        return 0
    store = TripleStore.read(spark, a.store)
    if a.verb == "count":
        print(store.size())
    elif a.verb == "explain":
        print(Engine(store).explain(parse_bgp(a.text)))
    else:
        frames = {
            "query": lambda: Engine(store, EngineConfig(order=a.order)).sparql(a.text),
            "dump": lambda: store.df.select("s", "p", "o"),
            "stats": store.statistics,
            "terms": lambda: build_dictionary(store.df, ["s", "p", "o"]),
        }
        df = frames[a.verb]()
        df = df.limit(a.rows) if a.rows is not None else df
        if a.out:
            write_rows(df, a.out, mode="overwrite")
        else:  # partition by partition, so that the driver never holds all
            for line in df.select(row_text(df)).toLocalIterator(prefetchPartitions=True):
                print(line[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
