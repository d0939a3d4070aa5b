"""What the jobs share: command line, config files, counting what was read and written."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from dataclasses import fields
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from beamloom.session import session
from beamloom.sources.workspace import shared_folder

log = logging.getLogger("beamloom.jobs")
S = TypeVar("S")


def settings(spark: SparkSession, path: str, kind: type[S]) -> S:
    """The settings in a JSON file, which may be remote; unknown names are errors."""
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if unknown := given.keys() - {f.name for f in fields(kind)}:
        raise ValueError(f"{path} has unknown settings: {', '.join(sorted(unknown))}")
    return kind(**given)


def command_line(name: str, about: str, paths: dict[str, str]) -> tuple[SparkSession, dict[str, str]]:
    """A session and the paths that the user gives; the config file beside the job is the default one."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    for path, text in paths.items():
        parser.add_argument(f"--{path}", required=True, help=text)
    parser.add_argument("--config", default=f"file://{Path(__file__).with_name(f'{name}.json')}", help="JSON file of settings")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return session(name), given


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the folder that driver and executors share; its files stay."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(table: DataFrame, what: str, by: str) -> None:
    """Log the rows of a written table by one of its columns, which has few values."""
    counts = {str(r[by]): r["count"] for r in table.groupBy(by).count().collect()}
    log.info("wrote %s: %d rows, %s", what, sum(counts.values()), ", ".join(f"{n} {k}" for k, n in sorted(counts.items())) or "none")
