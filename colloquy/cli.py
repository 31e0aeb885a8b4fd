"""Commands over a data set folder or requests: ``python -m colloquy.cli <command> --help``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import evaluation, scoring
from colloquy.plans import calls
from colloquy.schemas import FEATURE_NAMES, SEMANTIC_NAMES, acoustic_names, behavioural_names
from colloquy.session import session
from colloquy.sources import dataset, tables
from colloquy.streaming.segments import detections


def shown(rows: DataFrame, out: str | None) -> None:
    """As a markdown table; out: also as JSON files."""
    if out:
        tables.report(rows, out)
    print(tables.markdown(rows))


def paged(spark: SparkSession, args: argparse.Namespace, title: str, found: dict[str, DataFrame]) -> None:
    """The same as a page, where one is asked for."""
    if args.page:
        tables.save_page(tables.html_page(title, found), args.page)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    shown(evaluation.eval_summary(calls.benchmark_detectors(dataset.resolve(spark, args.root), args.split, (args.backend,))), args.out)


def vad_benchmark(spark: SparkSession, args: argparse.Namespace) -> None:
    shown(calls.benchmark_detectors(dataset.resolve(spark, args.root), args.split), args.out)


def benchmark(spark: SparkSession, args: argparse.Namespace) -> None:
    """Detectors, a guarded head for sound, texts and behaviour, and the training; each is ok or skipped."""
    data = dataset.resolve(spark, args.root)
    rows = calls.labelled_features(data, heavy=True, backend=args.backend).persist()
    texts = calls.with_transcripts(rows, tables.turns(spark, args.transcripts, texts=True)).persist() if args.transcripts and dataset.readable(spark, args.transcripts) else None
    suites = {"acoustic": acoustic_names(), "semantic": (texts, SEMANTIC_NAMES), "behavioral": behavioural_names()}
    print(json.dumps(evaluation.layer_benchmark(rows, suites, calls.benchmark_detectors(data, args.split)), indent=2))


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    data = dataset.resolve(spark, args.root)
    if args.tune:
        rows = {b: calls.labelled_features(data, backend=b).persist() for b in ("hybrid", "energy")}
        chosen, model, variants = evaluation.tune_heads(rows)
        found = [(v["id"], v["id"] == chosen, split, head, *[float(x[n]) for n in ("accuracy", "f1", "auc")]) for v in variants for split, heads in v["metrics"].items() for head, x in heads.items()]
        paged(spark, args, "Head tuning", {"variants": spark.createDataFrame(found, "id string, chosen boolean, split string, head string, accuracy double, f1 double, auc double")})
    else:
        model = calls.train_from(data, args.backend)
    tables.save_model(model, args.model, spark)
    print(json.dumps(model["metrics"], indent=2))


def explore(spark: SparkSession, args: argparse.Namespace) -> None:
    found = evaluation.explore(calls.labelled_features(dataset.resolve(spark, args.root), heavy=True, backend=args.backend).persist(), FEATURE_NAMES)
    stats = found["stats"].orderBy("split", "rank").persist()
    shown(stats, args.out)
    metrics = spark.createDataFrame([(s, *[float(m[n]) for n in ("accuracy", "precision", "recall", "f1", "auc")]) for s, m in found["metrics"].items()], "split string, accuracy double, precision double, recall double, f1 double, auc double")
    paged(spark, args, "Exploration of features", {"effect sizes": stats, f"head of {', '.join(found['stable'])}": metrics})
    print(json.dumps({k: found[k] for k in ("stable", "rank_correlation", "metrics")}, indent=2))


def serve(spark: SparkSession, args: argparse.Namespace) -> None:
    """Requests that are appended to the JSON lines of a spool folder are answered in another, each once, a micro-batch at a time."""
    model, checkpoint = tables.load_model(args.model, spark), f"{args.out.rstrip('/')}-checkpoint"
    detections(spark, args.requests, model, args.out, checkpoint, args.once).awaitTermination()


def latency(spark: SparkSession, args: argparse.Namespace) -> None:
    data = dataset.resolve(spark, args.root)
    shown(calls.compare_depths(data.audio(args.split), tables.load_model(args.model, spark)), args.out)


def inspect(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = scoring.score(calls.labelled_features(dataset.resolve(spark, args.root), backend=args.backend), tables.load_model(args.model, spark)).persist()
    shown(scoring.inspection(rows, scoring.is_positive(), "split"), args.out)
    misses = evaluation.misses(rows).select("call_id", "split", "label", F.col("p"), "p_acoustic", "p_behavioral")
    print(tables.markdown(misses))
    paged(spark, args, "Inspection", {"rates": scoring.inspection(rows, scoring.is_positive(), "split"), "misses, the most confident first": misses})


COMMANDS = {"eval": evaluate, "vad-benchmark": vad_benchmark, "benchmark": benchmark, "train": train, "explore": explore, "serve": serve, "latency": latency, "inspect": inspect}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="colloquy", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        one = commands.add_parser(name)
        one.add_argument("--root", help="the data set's folder")
        one.add_argument("--split", default="val", choices=("train", "val"))
        one.add_argument("--backend", default="hybrid", help="a registered detector")
        one.add_argument("--out", required=name == "serve", help="a folder for the result")
        if name in ("train", "serve", "latency", "inspect"):
            one.add_argument("--model", default="model", help="where the model is or goes")
        if name in ("explore", "inspect", "train"):
            one.add_argument("--page", help="a file for the report as a page")
        if name == "benchmark":
            one.add_argument("--transcripts", help="a folder of <call_id>.json with texts")
        if name == "train":
            one.add_argument("--tune", action="store_true", help="try detectors and loudness, keep the best")
        if name == "serve":
            one.add_argument("--requests", required=True, help="the folder whose .jsonl files requests are appended to")
            one.add_argument("--once", action="store_true", help="answer what is there and stop")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.command](spark or session(), args)


if __name__ == "__main__":
    main()
