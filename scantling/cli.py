"""Command line: ``python -m scantling.cli {extract,sweep,analyze,significance,plotdata,all} ...``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from scantling.plans import config as conf
from scantling.plans import pipeline
from scantling.sources import store, texts


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scantling")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("extract", "sweep", "analyze", "significance", "plotdata", "all"):
        p = sub.add_parser(name)
        p.add_argument("--config", default="config.yaml")
        p.add_argument("--results-dir")
        if name in ("extract", "sweep", "all"):
            p.add_argument("--model")
            p.add_argument("--dataset")
        if name in ("extract", "all"):
            p.add_argument("--source", action="append", default=[], metavar="DATASET=PATH")
            p.add_argument("--mode", choices=["standard", *pipeline.MODES, "all"], default="all", help="standard is another name of base")
            p.add_argument("--skip-filtering", action="store_true")
            p.add_argument("--overwrite", action="store_true")
        if name == "sweep":
            p.add_argument("--scorers", nargs="+")
        if name in ("significance", "all"):
            p.add_argument("--split", choices=["eval", "test"], default="test")
            p.add_argument("--metric", choices=["recall_at_1pct_fpr", "auroc"], default="recall_at_1pct_fpr")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    config = conf.load(args.config)
    if args.results_dir:
        config.results_dir = args.results_dir
    config = conf.narrowed(config, getattr(args, "model", None), getattr(args, "dataset", None))
    spark = SparkSession.builder.appName("scantling").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    if args.command in ("extract", "all"):
        modes = pipeline.MODES if args.mode == "all" else ("base" if args.mode == "standard" else args.mode,)
        for name, path in (x.split("=", 1) for x in args.source):
            given = texts.load(spark, name, path).select("sample_id", "text", "label")
            for model in config.models:
                pipeline.extract(spark, config, model, name, given, modes, args.skip_filtering, overwrite=args.overwrite)
    if args.command in ("sweep", "all"):
        pipeline.sweep(spark, config, getattr(args, "scorers", None))
    if args.command in ("analyze", "plotdata", "all"):
        tables = pipeline.analyze(store.read_runs(spark, f"{config.results_dir}/runs"), config)
        if args.command != "plotdata":
            pipeline.write_reports(tables, config.results_dir)
        if args.command != "analyze":
            pipeline.write_reports(pipeline.plot_data(tables), f"{config.results_dir}/figures")
    if args.command in ("significance", "all"):
        store.write_csv(pipeline.significance_report(spark, config, args.split, args.metric), f"{config.results_dir}/significance_{args.split}")


if __name__ == "__main__":
    main()
