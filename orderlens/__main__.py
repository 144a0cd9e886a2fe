"""Command line: build the store, run reports and tests, train and apply the risk model."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from orderlens import registry
from orderlens.plans import extracts as dash
from orderlens.plans import hypothesis, risk
from orderlens.plans import risk_model as models
from orderlens.plans.star import build_star
from orderlens.session import build_session
from orderlens.sources import store
from orderlens.sources.raw_csv import quarantine, read_raw

# Rows of a report that are printed; files hold all.
SHOWN = 100


def _etl(spark: SparkSession, args: argparse.Namespace) -> None:
    raw = read_raw(spark, args.raw, args.prefix)
    if args.quarantine:
        store.write_results(quarantine(raw), args.quarantine)
    for name, rows in store.write_star(build_star(raw), args.store).items():
        print(f"{name}: {rows} rows")
    star = store.read_star(spark, args.store)
    if args.csv:
        store.export_star(star, args.csv)
    if args.extracts:
        store.export_extracts(dash.extracts(star), args.extracts)


def _show(df: DataFrame, name: str, out: str | None) -> None:
    if out:
        store.write_csv(df, f"{out}/{name}")
    else:
        rows = df.count()
        print(name if rows <= SHOWN else f"{name}: the first {SHOWN} of {rows} rows; --out writes all")
        df.show(SHOWN, truncate=False)


def _report(spark: SparkSession, args: argparse.Namespace) -> None:
    star = store.read_star(spark, args.store)
    for name in args.names:
        _show(registry.REPORTS[name](star), name, args.out)


def _tests(spark: SparkSession, args: argparse.Namespace) -> None:
    summary = hypothesis.summary(store.read_star(spark, args.store))
    if args.out:
        store.write_results(summary, args.out)
    else:
        summary.show(truncate=False)


def _train(spark: SparkSession, args: argparse.Namespace) -> None:
    star = store.read_star(spark, args.store)
    metrics = models.all_metrics({n: risk.scores(star, n) for n in (models.LR, models.RF)})
    if args.out:
        store.write_results(metrics, args.out)
    metrics.show(truncate=False)
    models.save_model(risk.full_model(star, models.RF), args.model)


def _score(spark: SparkSession, args: argparse.Namespace) -> None:
    model = models.load_model(spark, args.model)
    if model is None:
        raise SystemExit(f"no model at {args.model}: run train first")
    scores = models.score_orders(model, spark.read.parquet(args.orders))
    tier = models.risk_tier(scores["prob_late_pct"])
    scores.withColumn("risk_tier", tier).write.mode("overwrite").parquet(args.out)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="orderlens", description=__doc__)
    parser.add_argument("--master", help="Spark master, unless spark-submit sets it")
    commands = parser.add_subparsers(required=True)

    def command(name: str, run, **options) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=run.__name__.strip("_"))
        sub.set_defaults(run=run)
        for option, required in options.items():
            sub.add_argument(f"--{option}", required=required)
        return sub

    etl = command("etl", _etl, raw=True, store=True, csv=False, extracts=False, quarantine=False)
    etl.add_argument("--prefix", default="", help="text before each raw file name")
    report = command("report", _report, store=True, out=False)
    report.add_argument("names", nargs="+", choices=sorted(registry.REPORTS), metavar="name")
    command("tests", _tests, store=True, out=False)
    command("train", _train, store=True, model=True, out=False)
    command("score", _score, model=True, orders=True, out=True)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    args.run(build_session(args.master), args)


if __name__ == "__main__":
    main()
