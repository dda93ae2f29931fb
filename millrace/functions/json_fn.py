"""JSON_SET, which no built-in expresses."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.errors import EngineError


def set_paths(doc: str | None, paths: list[str], values: list[str]) -> str | None:
    """``doc`` with the value at each path replaced or added; a missing parent changes nothing.

    An invalid document is error 3141, an invalid path 3143.
    """
    if doc is None:
        return None
    try:
        root = json.loads(doc)
    except ValueError:
        raise EngineError(3141, "Invalid JSON text in argument 1 to function json_set") from None
    for path, value in zip(paths, values, strict=True):
        if path is None or not re.fullmatch(r"\$(\.\w+)*", path):
            raise EngineError(3143, "Invalid JSON path expression")
        new, keys = json.loads(value), path.split(".")[1:]
        if not keys:
            root = new
            continue
        at = root
        for key in keys[:-1]:
            at = at.get(key) if isinstance(at, dict) else None
        if isinstance(at, dict):
            at[keys[-1]] = new
    return json.dumps(root, ensure_ascii=False, sort_keys=True)


def register(spark: SparkSession) -> None:
    @F.pandas_udf("string")
    def millrace_json_set(doc: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([set_paths(d, list(p), list(v)) for d, p, v in zip(doc, paths, values, strict=True)], dtype=object)

    spark.udf.register("millrace_json_set", millrace_json_set)
