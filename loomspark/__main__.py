"""Command line: generate (dry runs with the stub model) and convert."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from loomspark.plans.config import ConversionConfig, GenerationConfig, load


def _setting(text: str) -> tuple[str, object]:
    import yaml

    name, eq, value = text.partition("=")
    if not eq:
        raise argparse.ArgumentTypeError(f"{text} is not NAME=VALUE")
    return name, yaml.safe_load(value)


def _nested(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for name, value in pairs:
        at = out
        *steps, last = name.split(".")
        for s in steps:
            at = at.setdefault(s, {})
        at[last] = value
    return out


def _count(text: str) -> tuple[str, int]:
    name, value = _setting(text)
    if not isinstance(value, int):
        raise argparse.ArgumentTypeError(f"{text} is not NAME=COUNT")
    return name, value


def _flags(args: argparse.Namespace) -> dict:
    """Settings of the flags that take several values."""
    if args.command == "convert":
        return {k: v for k, v in (("input_path", args.input_path), ("groups_json", args.groups_json)) if v}
    out: dict = {"seed_source": {"file_extensions": args.file_extensions}} if args.file_extensions else {}
    counts = {k: dict(v) for k, v in (("query_counts", args.query_counts), ("reasoning_counts", args.reasoning_counts)) if v}
    return out | ({"pipeline": counts} if counts else {})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomspark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("generate", "convert"):
        own = commands.add_parser(name)
        own.add_argument("--config")
        own.add_argument("--set", action="append", type=_setting, default=[], metavar="NAME=VALUE")
        if name == "generate":
            own.add_argument("--file-extensions", nargs="+", metavar="EXTENSION")
            own.add_argument("--query-counts", nargs="+", type=_count, metavar="NAME=COUNT")
            own.add_argument("--reasoning-counts", nargs="+", type=_count, metavar="NAME=COUNT")
            own.add_argument("--preview", type=int, metavar="RECORDS")
        else:
            own.add_argument("input_path", nargs="?")
            own.add_argument("--groups-json", nargs="+", metavar="PATH")
    args = parser.parse_args(argv)
    kind = GenerationConfig if args.command == "generate" else ConversionConfig
    try:
        config, _ = load(kind, args.config, _nested(args.set), _flags(args))
    except (ValueError, OSError) as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("loomspark").getOrCreate()
    try:
        if args.command == "generate":
            from loomspark.plans.generate import StubClient, generate, preview

            client = StubClient(config.pipeline.num_pairs)
            if args.preview:
                preview(spark, config, client, args.preview).show(args.preview, truncate=80)
            else:
                print(generate(spark, config, client))
        else:
            from loomspark.plans.convert import convert

            print(convert(spark, config))
    except (FileNotFoundError, FileExistsError, ValueError) as e:
        print(f"run: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
