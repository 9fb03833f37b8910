"""Command line: python -m veilspan redact|benchmark|compare|accounts|leaks|shards|splits ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def redact(spark: SparkSession, a: argparse.Namespace) -> None:
    """Parquet with a text column in, the same with `redacted` out."""
    from .operators.methods import method

    method(a.method).leak_tagged(spark.read.parquet(a.calls), a.text).write.mode("error").parquet(a.out)


def benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    """Scores of predictions (doc_id, i, text, label) against gold (doc_id, j, text, label)."""
    from .operators import matching
    from .sources.reports import format_gate, format_scores

    pred, gold = spark.read.parquet(a.pred), spark.read.parquet(a.gold)
    counts = matching.label_counts(matching.outcomes(pred, gold)).cache()
    rows = [r.asDict() | {"method": a.method} for r in matching.with_scores(counts).orderBy("label").collect()]
    rows += [r.asDict() | {"method": a.method, "label": r["labels"]} for r in matching.overall(counts).collect()]
    report = format_scores(rows, "benchmark")
    if a.gate:
        report += "\n" + format_gate(matching.gate(counts).orderBy("label").collect())
    if a.out:
        spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("error").text(a.out)
    print(report)


def accounts(spark: SparkSession, a: argparse.Namespace) -> None:
    """Account survival of calls (doc_id, text, accounts), and the rate of calls that lost theirs."""
    from .operators import leaks
    from .operators.methods import method

    calls = method(a.method).account_spans(spark.read.parquet(a.calls)).withColumn("spans", F.transform("spans", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["label"].alias("label"))))
    survival = leaks.account_survival(calls)
    survival.write.mode("error").parquet(a.out)
    print(leaks.unrecoverable_rate(calls, spark.read.parquet(a.out)).first().asDict())


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Arms against one gold, each `name=all labels' predictions[,base labels' predictions]`."""
    from .operators import matching
    from .operators.vocab import BASE, CANON
    from .sources.reports import format_comparison

    gold, rows, overall, safe = spark.read.parquet(a.gold), [], [], []
    for arm in a.arms:
        name, _, paths = arm.partition("=")
        for kind, labels, path in zip(("all", "base"), (CANON, BASE), paths.split(",")):
            found = matching.outcomes(spark.read.parquet(path), gold.filter(F.col("label").isin(labels)))
            counts = matching.label_counts(found).cache()
            own = {"method": name, "labels": kind}
            rows += [r.asDict() | own for r in matching.gate(counts, labels=labels).orderBy("label").collect()]
            overall += [r.asDict() | own for r in matching.overall(counts).filter(F.col("labels") == kind).collect()]
            if kind == "all":
                safe.append(matching.nric_protection(found).first().asDict() | own)
    report = format_comparison(rows, overall, safe)
    if a.out:
        spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("error").text(a.out)
    print(report)


def leaks(spark: SparkSession, a: argparse.Namespace) -> None:
    """Leak cards of a method's judge shards over its redacted lines (JSON: line, redacted), with
    file names (parquet: line, file), and the rates of leaking files and customers."""
    from .operators import leaks as own
    from .sources import corpus_files, reports

    judged = corpus_files.read_judged(spark, a.judged, a.method)
    names = spark.read.parquet(a.names)
    reports.write_html(reports.leak_cards(own.leak_items(judged), corpus_files.read_redacted(spark, a.redacted), names), f"Leaks, {a.method}", a.out)
    print(own.leak_rates(names, judged).first().asDict())


def shards(spark: SparkSession, a: argparse.Namespace) -> None:
    """Redacted lines (JSON: line, redacted) in contiguous shards, a folder each."""
    from .operators.corpus import shards as cut_up
    from .sources import corpus_files

    lines = corpus_files.read_redacted(spark, a.redacted)
    corpus_files.write_shards(cut_up(lines, lines.count(), a.pieces), a.out)


def splits(spark: SparkSession, a: argparse.Namespace) -> None:
    """JSON lines of the folders train, val and test below a folder (those that there are), with
    a report; nothing is written if a folder has no usable record or train and val share one."""
    from .operators import corpus
    from .sources import corpus_files

    built = {}
    for name in a.names:
        records, rejects = corpus_files.read_split(spark, f"{a.folder}/{name}", name)
        for r in rejects.orderBy("file").collect():
            print(f"left out of {name}: {r['file']}: {r['reason']}")
        if records.isEmpty():
            raise SystemExit(f"no usable record in {a.folder}/{name}")
        built[name] = records
    if {"train", "val"} <= set(built) and not corpus.shared_inputs(built["train"], built["val"]).isEmpty():
        raise SystemExit("train and val share records; nothing was written")
    if "train" in built:
        missing = [r["label"] for r in corpus.missing_labels(built["train"], "file").orderBy("label").collect()]
        if missing:
            print("train has no gold for:", ", ".join(missing))
    for name, records in built.items():
        corpus_files.write_records(records.sort("file"), f"{a.out}/{name}")
        print(corpus.split_report(records).first().asDict())


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veilspan")
    sub = p.add_subparsers(dest="command", required=True)
    commands = (
        (redact, ("calls", "out")), (benchmark, ("pred", "gold")), (compare, ("gold",)), (accounts, ("calls", "out")),
        (leaks, ("judged", "redacted", "names", "out")), (shards, ("redacted", "out")), (splits, ("folder", "out")),
    )
    for f, args in commands:
        s = sub.add_parser(f.__name__, help=f.__doc__)
        for x in args:
            s.add_argument(x)
        s.add_argument("--method", default="rulebased")
        s.set_defaults(run=f)
        if f is redact:
            s.add_argument("--text", default="text")
        if f is benchmark:
            s.add_argument("--gate", action="store_true")
        if f is compare:
            s.add_argument("arms", nargs="+", help=compare.__doc__)
        if f in (benchmark, compare):
            s.add_argument("-o", "--out")
        if f is shards:
            s.add_argument("--pieces", type=int, default=8)
        if f is splits:
            s.add_argument("--names", nargs="+", default=["train", "val", "test"])
    a = p.parse_args(argv)
    a.run(SparkSession.builder.appName(f"veilspan-{a.command}").getOrCreate(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
