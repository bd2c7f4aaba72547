"""What the jobs share: configuration, their session, log lines."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv")


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """``defaults`` with the values of the JSON file at ``path``; ValueError for a name that the job doesn't know."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())  # one small file
    given = json.loads(text)
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}; known are {', '.join(sorted(defaults))}")
    return {**defaults, **given}


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    # quoted values may hold line ends
    reader = spark.read.options(header=True, inferSchema=True, multiLine=True) if kind == "csv" else spark.read
    return reader.format(kind).load(path)


def command(description: str, inputs: dict[str, str], run: Callable[..., dict], defaults: dict, argv: list[str] | None = None) -> None:
    """Parse paths, start a session, run the job, print its summary as JSON and stop the session."""
    parser = argparse.ArgumentParser(description=description)
    for name, text in inputs.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="JSON file of settings")
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        path = args.pop("config")
        config = read_config(spark, path, defaults) if path else dict(defaults)
        print(json.dumps(run(spark, **args, config=config), sort_keys=True))
    finally:
        spark.stop()
