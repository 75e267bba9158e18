"""Command line: introspect, profile, generate, simulate, comply, validate, reset."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import compliance
from millrace.plans import generate, grow, profiler, scenario, simulate
from millrace.plans.schema import SchemaGraph, resolve
from millrace.sources import catalog, offline, sinks


COMMANDS = ("introspect", "profile", "generate", "simulate", "comply", "validate", "reset", "completions")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        c.add_argument("directory", nargs="?" if name == "completions" else None, help="folder of Parquet tables (simulate and validate: ignored)")
        c.add_argument("--include", nargs="*", default=[])
        c.add_argument("--exclude", nargs="*", default=[])
        c.add_argument("--output")
        c.add_argument("--format", choices=("table", "json", "yaml"), default="json")
        c.add_argument("--scenario", help="file or template name")
        c.add_argument("--profile", help="profile document: generate from it, or comply with it")
        c.add_argument("--scale", type=float, default=1.0, help="with --profile, over 0 and at most 1")
        c.add_argument("--tolerance", type=float, default=compliance.TOLERANCE)
        c.add_argument("--export", action="store_true", help="profile: write the offline results instead of the document")
        c.add_argument("--import-results", help="profile: make the document of offline results")
        c.add_argument("--entities", nargs="*", default=[], help="table=count")
        c.add_argument("--seed", type=int)
        c.add_argument("--keys", help="JSON file of foreign keys: a list of [table, column, parent, parent column]")
        c.add_argument("--discover", action="store_true", help="find keys, unique sets and labels in the data")
        c.add_argument("--dry-run", action="store_true")
        c.add_argument("--confirm", action="store_true")
    return p


def _scenario(args: argparse.Namespace) -> scenario.Scenario:
    if args.profile:
        s = scenario.from_profile(sinks.load_profile(args.profile), args.scale)
    else:
        name = args.scenario or "ecommerce"
        s = scenario.template(name) if name in scenario.TEMPLATES else scenario.load(name)
    return s.with_counts({k: int(v) for k, v in (x.split("=") for x in args.entities)})


def _print(df: DataFrame) -> None:
    print(*df.columns, sep="\t")
    for row in df.toLocalIterator():
        print(*row, sep="\t")


def _graph(args: argparse.Namespace, spark: SparkSession) -> SchemaGraph:
    """By the data, by the declared keys, or else by those of the given tables that the folder has."""
    if args.discover:
        return catalog.discovered(spark, args.directory)
    return catalog.introspect(spark, args.directory, catalog.declared(args.keys) if args.keys else catalog.DRIVER_KEYS)


def _profile(args: argparse.Namespace, spark: SparkSession, graph: SchemaGraph) -> None:
    if args.dry_run:
        print(*map(" ".join, profiler.planned(graph)), sep="\n")
        return
    if args.export:
        frames = {t.name: spark.read.parquet(f"{args.directory}/{t.name}.parquet") for t in graph.tables}
        text = offline.export_profile(frames, graph).first().document
        if args.output:
            sinks.write_text(text, args.output)
        else:
            print(text)
        return
    doc = offline.import_profile(sinks.read_text(args.import_results)) if args.import_results else profiler.collect(spark, args.directory, graph)
    if args.output:
        sinks.save_profile(doc, args.output)
    else:
        print(json.dumps(doc, indent=2, default=str))


def _generate(args: argparse.Namespace, spark: SparkSession, graph: SchemaGraph) -> None:
    s = _scenario(args)
    if args.dry_run:
        print(json.dumps(s.row_counts(resolve(graph).order), indent=2))
        return
    seed = scenario.effective_seed(args.seed, s, int(time.time()))
    frames = grow.grow(spark, graph, s, seed) if s.lifecycle else generate.generate(spark, graph, s, seed)
    output = args.output or f"{args.directory}/generated"
    generate.write(frames, output)
    if args.profile:
        _print(compliance.profile_checks(sinks.load_profile(args.profile), {n: spark.read.parquet(f"{output}/{n}.parquet") for n in frames}, args.tolerance))


def _comply(args: argparse.Namespace, spark: SparkSession) -> int:
    profile = sinks.load_profile(args.profile)
    names = set(catalog.table_names(spark, args.directory)) & set(profile["tables"])
    checks = compliance.profile_checks(profile, {n: spark.read.parquet(f"{args.directory}/{n}.parquet") for n in names}, args.tolerance)
    _print(checks)
    return int(not checks.where("not passed").isEmpty())


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "completions":
        print(f"complete -W '{' '.join(COMMANDS)}' millrace")
        return 0
    if args.command == "validate":
        s = _scenario(args)
        print(f"{len(s.tables)} tables, {'with' if s.lifecycle else 'without'} a lifecycle")
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "simulate":
        _print(simulate.simulate(spark, _scenario(args), args.seed).orderBy("table", "b"))
        return 0
    if args.command == "comply":
        return _comply(args, spark)
    graph = _graph(args, spark).filtered(tuple(args.include), tuple(args.exclude))
    if args.command == "introspect":
        print(catalog.render(graph, args.format))
    elif args.command == "reset":
        print(*sinks.reset(spark, args.directory, resolve(graph).order, args.confirm))
    elif args.command == "profile":
        _profile(args, spark, graph)
    else:
        _generate(args, spark, graph)
    return 0


if __name__ == "__main__":
    sys.exit(main())
