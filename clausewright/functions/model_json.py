"""JSON lists recovered from what language models answer."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")


def _as_list(value: object) -> list | None:
    if isinstance(value, list):
        return value
    if isinstance(value, dict) and isinstance(value.get("requirements"), list):
        return value["requirements"]
    return None


def recover_json_array(raw: str | None) -> tuple[list | None, bool]:
    """(items, recovered_truncated). A fenced or plain list; else the list that starts
    at the first bracket; else, where that never closes, its complete objects."""
    if raw is None:
        return None, False
    text = _FENCE.sub("", raw).strip()
    try:
        if (whole := _as_list(json.loads(text))) is not None:
            return whole, False
    except ValueError:
        pass
    start = text.find("[")
    if start < 0:
        return None, False
    try:
        value, _ = json.JSONDecoder().raw_decode(text[start:])
        return (value, False) if isinstance(value, list) else (None, False)
    except ValueError:
        pass
    items, at, decoder = [], start + 1, json.JSONDecoder()
    while at < len(text):
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        if not isinstance(value, dict):
            break
        items.append(value)
    return (items, True) if items else (None, False)


def recover_json_object(raw: str | None) -> dict | None:
    """A fenced or plain object; else the one that starts at the first brace; a list of
    one object counts as that object. Nothing is recovered of one that never closes."""
    if raw is None:
        return None
    text = _FENCE.sub("", raw).strip()
    for start in dict.fromkeys((0, text.find("{"))):
        if start < 0:
            continue
        try:
            value, _ = json.JSONDecoder().raw_decode(text[start:])
        except ValueError:
            continue
        if isinstance(value, list) and len(value) == 1:
            value = value[0]
        if isinstance(value, dict):
            return value
    return None


@F.pandas_udf(StructType([StructField("items", ArrayType(StringType())), StructField("recovered", BooleanType())]))
def recover_json_array_udf(raw: pd.Series) -> pd.DataFrame:
    got = [recover_json_array(x) for x in raw]
    return pd.DataFrame({"items": [None if i is None else [json.dumps(v, ensure_ascii=False, sort_keys=True) for v in i] for i, _ in got], "recovered": [r for _, r in got]})
