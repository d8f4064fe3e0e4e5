"""Functions of a user run over the rows of a catalogue, and kernels that enrich recordings.

``batch_process`` is the general form of a batch operator: a condition chooses rows, a function maps
them, and the rows that are not chosen are kept or left out. Errors are skipped or raised.
"""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path
from types import ModuleType
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batch_process(
    df: DataFrame, condition: Column, function: Callable[[dict], Any], *, result: str = "value", returns: str = "string", out: str = "result",
    patch: bool = True, on_error: str = "fail",
) -> DataFrame:
    """Map ``function`` over the rows that fulfil ``condition``, Arrow batch by batch.

    ``result='value'`` adds column ``out`` of type ``returns``; ``'series'`` takes a dictionary of changed columns.
    With ``patch`` the other rows stay (value null, series unchanged), else they are left out. ``on_error='skip'``
    gives rows that fail a null value or leaves them unchanged and puts the message into ``_error``.
    """
    if result not in ("value", "series") or on_error not in ("fail", "skip"):
        raise ValueError("result is 'value' or 'series', on_error is 'fail' or 'skip'")
    rows = df if patch else df.where(condition)
    rows = rows.withColumn("_go", F.coalesce(condition, F.lit(False)))
    fields = [*df.schema.fields]
    if result == "value":
        fields.append(T._parse_datatype_string(f"{out} {returns}").fields[0])
    if on_error == "skip":
        fields.append(T.StructField("_error", T.StringType()))
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for go, row in zip(pdf["_go"], pdf.drop(columns="_go").to_dict("records"), strict=True):
                row |= {n: None for n in (out if result == "value" else "", "_error" if on_error == "skip" else "") if n}
                if go:
                    try:
                        got = function(dict(row))
                        row |= {out: got} if result == "value" else got
                    except Exception as e:  # noqa: BLE001
                        if on_error == "fail":
                            raise
                        row["_error"] = f"{type(e).__name__}: {e}"
                made.append(row)
            yield pd.DataFrame(made, columns=names).astype({n: "object" for n in names if not made})

    return rows.mapInPandas(run, T.StructType(fields))


class Pipeline:
    """Functions of a DataFrame applied one after the other."""

    def __init__(self, functions: list[Callable[[DataFrame], DataFrame]]):
        self.functions = list(functions)

    def forward(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, f: d.transform(f), self.functions, df)


def load_kernel(spec: str | ModuleType) -> Any:
    """The object ``KERNEL`` of a file (with or without ``.py``) or of an importable module.

    FileNotFoundError or ImportError if there is none, TypeError if it has no ``apply``.
    """
    if isinstance(spec, ModuleType):
        module = spec
    else:
        path = next((p for p in (Path(spec), Path(f"{spec}.py")) if p.is_file()), None)
        if path is not None:
            loaded = importlib.util.spec_from_file_location(path.stem, path)
            module = importlib.util.module_from_spec(loaded)
            loaded.loader.exec_module(module)
        elif "/" in spec or spec.endswith(".py"):
            raise FileNotFoundError(spec)
        else:
            module = importlib.import_module(spec)
    kernel = getattr(module, "KERNEL", None)
    if kernel is None or not callable(getattr(kernel, "apply", None)):
        raise TypeError("a kernel is an object KERNEL with a method apply")
    return kernel


def apply_kernel(recordings: DataFrame, annotations: DataFrame, kernel: Any, schema: str, key: str = "rec_id") -> DataFrame:
    """Rows that ``kernel.apply(recording rows, annotation rows)`` makes for each recording.

    Only recordings that are not ``Unavailable`` are given to it, unless it says HANDLES_UNAVAILABLE. One
    recording's annotations are the unit of work.
    """
    live = recordings if getattr(kernel, "HANDLES_UNAVAILABLE", False) else recordings.where("coalesce(status, '') <> 'Unavailable'")
    return live.groupBy(key).cogroup(annotations.join(live.select(key), key, "left_semi").groupBy(key)).applyInPandas(lambda a, b: kernel.apply(a, b), schema)


def logged(function: Callable) -> Callable:
    """``function`` of a row that logs the row before it is handled, at level INFO of the logger of its module."""
    import functools
    import logging

    log = logging.getLogger(function.__module__)

    @functools.wraps(function)
    def run(row, *args, **kwargs):
        log.info("row %s", row)
        return function(row, *args, **kwargs)

    return run
