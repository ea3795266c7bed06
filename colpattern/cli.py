"""Command line: python -m colpattern.cli compress|decompress|info -i FILE [-o FILE] [-f FORMAT]."""

from __future__ import annotations

import argparse
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from colpattern.config import EncodeConfig
from colpattern.operators.rows import with_rid
from colpattern.plans import codec
from colpattern.pretty import pretty
from colpattern.sources import tables
from colpattern.sources.document import parse


def detect(name: str, content: str) -> str:
    head = content.lstrip()
    for end, kind in ((".csv", "csv"), (".json", "json"), (".colp", "document"), (".log", "syslog")):
        if name.endswith(end):
            return kind
    if head[:1] in ("[", "{"):
        return "json"
    return "document" if head.startswith(("!v", "!x", "!ctx", "#", "$")) else "csv"


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="colpattern")
    p.add_argument("command", choices=("compress", "decompress", "info"))
    p.add_argument("-i", "--input", default="-")
    p.add_argument("-o", "--output", default="-")
    p.add_argument("-f", "--format", default="auto", choices=("auto", "csv", "json", "syslog", "document"))
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--threshold", type=float, default=1.2)
    a = p.parse_args(args)
    text = sys.stdin.read() if a.input == "-" else Path(a.input).read_text()
    kind = detect(a.input, text) if a.format == "auto" else a.format
    began = time.time()
    if a.command == "info":
        result = pretty(parse(text), a.verbose)
    else:
        spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
        result = compress(spark, text, kind, EncodeConfig(fallback_threshold=a.threshold)) if a.command == "compress" else decompress(spark, text, "json" if kind == "json" or a.output.endswith(".json") else "csv")
    (sys.stdout.write(result) if a.output == "-" else Path(a.output).write_text(result))
    if a.verbose and not a.quiet:
        n, m = len(text.encode()), len(result.encode())
        print(f"{n} -> {m} bytes, ratio {n / max(m, 1):.2f}, saved {100 * (1 - m / max(n, 1)):.1f} %, {n / 1e6 / max(time.time() - began, 1e-9):.2f} MB/s", file=sys.stderr)
    return 0


def compress(spark: SparkSession, text: str, kind: str, config: EncodeConfig) -> str:
    """One document of a text in the given format."""
    with tempfile.TemporaryDirectory() as d:
        at = Path(d) / "input"
        at.write_text(text)
        if kind == "json":
            docs = codec.compress_json(spark, str(at), config)
        elif kind == "syslog":
            from colpattern.operators.syslog import parse as parse_log

            rows = with_rid(parse_log(tables.read_lines(spark, str(at))).drop("line"), ["rid"], name="_at").drop("rid")
            docs = codec.compress(rows, dense="_at", chunk_rows=None, config=config, drop_index=True)
        else:
            docs = codec.compress_csv(spark, str(at), None, config)
        found = docs.select("document").first()
    return found["document"] if found else "!v1\n"


def decompress(spark: SparkSession, text: str, kind: str) -> str:
    docs = spark.createDataFrame([(0, text)], "chunk long, document string")
    table = codec.decompress(docs).drop("chunk")
    if kind == "json":
        return tables.json_array(table)
    names = [c for c in table.columns if c != "rid"]
    lines = [",".join(names)] + [r["line"] for r in tables.csv_lines(table.select("rid", *[F.col(f"`{n}`") for n in names])).orderBy("rid").collect()]
    return "\n".join(lines) + "\n"


if __name__ == "__main__":
    sys.exit(main())
