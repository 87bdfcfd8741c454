"""Logging of jobs, the time stamp of their files, and parameters from a file."""

from __future__ import annotations

import json
import logging
import os
import sys
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how a time stamp is written, for Python and for Spark.
STAMP, STAMP_SQL = "%Y%m%d_%H%M%S", "yyyyMMdd_HHmmss"


def stamp(at: Column | None = None) -> Column:
    """A time stamp as text, the present one if none is given."""
    return F.date_format(F.current_timestamp() if at is None else at, STAMP_SQL)


def logger(name: str, folder: str | None = None) -> logging.Logger:
    """Messages from INFO on to the console and, with a folder, from DEBUG on to a dated file; handlers are added once."""
    log = logging.getLogger(name)
    log.setLevel(logging.DEBUG)
    layout = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
    if not any(type(h) is logging.StreamHandler for h in log.handlers):
        console = logging.StreamHandler(sys.stderr)
        console.setLevel(logging.INFO)
        console.setFormatter(layout)
        log.addHandler(console)
    if folder and not any(isinstance(h, logging.FileHandler) for h in log.handlers):
        os.makedirs(folder, exist_ok=True)
        file = logging.FileHandler(os.path.join(folder, f"{name}_{datetime.now().strftime(STAMP)}.log"))
        file.setLevel(logging.DEBUG)
        file.setFormatter(layout)
        log.addHandler(file)
    return log


def parameters(path: str, defaults: dict | None = None) -> dict:
    """The parameters of a JSON file, or of a YAML file where a YAML reader is installed, over the defaults."""
    with open(path) as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: no YAML reader is installed; give the parameters as JSON") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    return {**(defaults or {}), **(found or {})}
