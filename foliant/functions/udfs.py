"""The few functions that built-in expressions cannot state, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii"))


def _objects(text: str) -> Iterator[str]:
    """The JSON objects that start at some brace of a text, in order, whatever surrounds them."""
    read = json.JSONDecoder().raw_decode
    for brace in re.finditer("{", text):
        with suppress(ValueError, RecursionError):
            yield json.dumps(read(text, brace.start())[0], ensure_ascii=False)


@F.pandas_udf(StringType())
def extract_json(s: pd.Series) -> pd.Series:
    """The first JSON object that stands in a text."""
    return s.map(lambda t: None if t is None else next(_objects(t), None))
