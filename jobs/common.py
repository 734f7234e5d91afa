"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable


def main(job: Callable, description: str, args: list[str] | None = None) -> None:
    """Run ``job`` in a session of its own with the values of a config file; options of the same names come before them."""
    from pyspark.sql import SparkSession

    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", required=True)
    with open(first.parse_known_args(args)[0].config, "rb") as f:
        config = tomllib.load(f)
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", required=True, help="a TOML file with the values below")
    for name, value in config.items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value, help="default: %(default)s")
    values = vars(parser.parse_args(args))
    values.pop("config")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job.__name__).getOrCreate()
    try:
        job(spark, **values)
    finally:
        spark.stop()
