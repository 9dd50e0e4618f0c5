"""Command line: python -m loomframe VERB [MODE] INPUT... --out PATH [--options JSON]

    python -m loomframe transform @calc orders.parquet --out net.parquet --options '{"expression": "price * 2", "name": "net"}'
    python -m loomframe to orders.csv customers.csv --out joined.parquet --options '{"bring": "name", "against": "id"}'
    python -m loomframe scan @analyze orders.parquet
    python -m loomframe scan @diff old.parquet new.parquet --out changes.json --options '{"key": "id"}'
    python -m loomframe synthetic @new --out made.parquet --options '{"n": 1000, "strategy": {"a": "normal(0, 1)"}}'

Formats go by the end of a path: .csv (with a header), .json, or Parquet. Without --out the first rows are shown.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

import loomframe as lf
from loomframe.errors import LoomError
from loomframe.sources.frames import read, write


def _format(path: str) -> tuple[str, dict]:
    end = path.rstrip("/").rpartition(".")[2].lower()
    return {"csv": ("csv", {"header": True}), "json": ("json", {})}.get(end, ("parquet", {}))


def _read(spark: SparkSession, path: str) -> DataFrame:
    kind, options = _format(path)
    return read(spark, path, kind, **options, **({"inferSchema": True} if kind == "csv" else {}))


def run(spark: SparkSession, verb: str, words: Sequence[str], options: dict) -> DataFrame:
    """The frame that a command line asks for."""
    mode = words[0] if words and words[0].startswith("@") else None
    frames = [_read(spark, w) for w in words[1 if mode else 0 :]]
    if verb == "to" and len(frames) > 1:
        return lf.to(frames[0], frames[1:], options.pop("bring"), options.pop("against"), **options)
    if verb == "transform" and mode and len(frames) == 1:
        return lf.transform(mode, frames[0], **options)
    if verb == "scan" and mode == "@diff" and len(frames) == 2:
        return lf.scan(mode, old=frames[0], new=frames[1], **options)
    if verb == "scan" and mode == "@analyze" and len(frames) == 1:
        return lf.scan(mode, frames[0], **options)
    if verb == "synthetic" and (mode == "@new" or len(frames) == 1):
        return lf.synthetic(mode or frames[0], **options)
    raise LoomError(f"'{verb}' doesn't work on {' '.join(words) or 'nothing'}", "See python -m loomframe --help")


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("verb", choices=["to", "transform", "scan", "synthetic"])
    parser.add_argument("words", nargs="*", metavar="MODE or INPUT")
    parser.add_argument("--out")
    parser.add_argument("--options", default="{}", type=json.loads)
    given = parser.parse_args(arguments)
    out = run(SparkSession.builder.getOrCreate(), given.verb, given.words, dict(given.options))
    if given.out:
        kind, options = _format(given.out)
        write(out, given.out, kind, "overwrite", **options)
    else:
        out.show(50, truncate=False)


if __name__ == "__main__":
    main()
