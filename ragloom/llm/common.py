"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer file; ``folder`` overrides the installed place.

    Called inside the tasks too, so every executor opens its own installed copy.
    """
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def text_of(text_col: str) -> Column:
    """The text column with null read as empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def frozen(df: DataFrame) -> DataFrame:
    """Reliable checkpoint under ``spark.checkpoint.dir`` (never a local one)."""
    from ragloom.session import cut_lineage
    return cut_lineage(df)


_LOADED: dict = {}


def per_process(key: tuple, make: Callable):
    """One instance per worker process of something expensive to load."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]
