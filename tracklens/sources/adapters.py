"""Recognisers' raw outputs by name, and results kept on disk by what made them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import segment

ADAPTERS: dict[str, Callable[..., DataFrame]] = {"characters": segment.from_characters, "items": segment.from_items}


def adapter(name: str) -> Callable[..., DataFrame]:
    """The function that turns a recogniser's raw table into segments."""
    if name not in ADAPTERS:
        raise KeyError(f"no adapter {name!r}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]


def kept(spark: SparkSession, folder: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written once for each ``config`` and read from then on.

    The path holds a digest of the configuration, so a changed setting is never served an old result;
    only a table whose writing was completed counts.
    """
    key = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
