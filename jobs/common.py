"""What the jobs' command lines share: configuration, logging, a session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def configured(parser: argparse.ArgumentParser, *paths: str) -> dict:
    """The configuration file's values; paths given on the command line come before them."""
    parser.add_argument("--config", required=True, help="JSON file on this machine")
    for name in paths:
        parser.add_argument(f"--{name}", help="in place of the file's value; any path Spark reads")
    given = vars(parser.parse_args())
    with open(given.pop("config")) as file:
        found = json.load(file) | {k: v for k, v in given.items() if v is not None}
    if missing := [p for p in paths if not found.get(p)]:
        parser.error(f"no value for {', '.join(missing)}")
    return found


@contextmanager
def session(name: str) -> Iterator[SparkSession]:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        yield spark
    finally:
        spark.stop()
