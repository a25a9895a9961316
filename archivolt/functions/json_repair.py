"""JSON out of model output: fences and reasoning dropped, the first object that parses, or its whole pairs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

WRAPPING = re.compile(r"<think>.*?(?:</think>|\Z)|```(?:json)?", re.DOTALL)


def first_object(text: str | None) -> dict | None:
    """The first object in the text that parses."""
    bare, read = WRAPPING.sub("", text or ""), json.JSONDecoder(strict=False)
    at = bare.find("{")
    while at >= 0:
        try:
            found, _ = read.raw_decode(bare, at)
            if isinstance(found, dict):
                return found
        except json.JSONDecodeError:
            pass
        at = bare.find("{", at + 1)
    return None


def whole_pairs(text: str | None) -> dict | None:
    """Of an object that was cut off, the pairs of its first level that are whole."""
    bare = WRAPPING.sub("", text or "")
    at, out, read = bare.find("{") + 1, {}, json.JSONDecoder(strict=False)
    if not at:
        return None
    skip = re.compile(r"[\s,]*")
    while True:
        at = skip.match(bare, at).end()
        try:
            key, at = read.raw_decode(bare, at)
            colon = re.compile(r"\s*:\s*").match(bare, at)
            value, at = read.raw_decode(bare, colon.end())
        except (json.JSONDecodeError, AttributeError):
            break
        # a bare number at the very end may have lost digits
        if at == len(bare) and not isinstance(value, str | dict | list):
            break
        out[key] = value
    return out or None


@F.pandas_udf(T.StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """Each text's object as JSON, whole or by its whole pairs; null where there is none."""
    def one(text):
        found = first_object(text) or whole_pairs(text)
        return json.dumps(found, ensure_ascii=False) if found is not None else None

    return texts.map(one)
