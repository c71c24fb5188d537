"""The last JSON object in an answer."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import strip

_FENCE = re.compile("```(?:json)?")
_SURROGATE = re.compile("[\ud800-\udfff]")
_READ = json.JSONDecoder()


def last_object(answer: str | None) -> dict:
    """The last JSON object that stands on its own in `answer`, {} where there is none. Code fences are
    dropped; an opening brace that starts no valid value is skipped; halves of characters become
    U+FFFD."""
    text, at, best = _FENCE.sub("", answer or ""), 0, {}
    while (at := text.find("{", at)) >= 0:
        try:
            best, at = _READ.raw_decode(text, at)
        except json.JSONDecodeError:
            at += 1
        except RecursionError:  # nested beyond reading: as good as malformed
            at += 1
    if not best:
        return {}
    plain = json.dumps(best, ensure_ascii=False)
    return json.loads(_SURROGATE.sub("�", plain)) if _SURROGATE.search(plain) else best


def _text(value) -> str | None:
    return value if isinstance(value, str) else None if value is None else json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _fields(answers: pd.Series) -> pd.Series:
    return answers.map(lambda a: {k: _text(v) for k, v in last_object(a).items()})


def answer_fields(answer: Column | str) -> Column:
    """MAP<STRING,STRING> of the last object's members; values that are not text are their JSON. An answer
    that is one flat object is read in the JVM, all others by the scanner; null is an empty map."""
    a = F.col(answer) if isinstance(answer, str) else answer
    flat = strip(a).rlike(r'^\{[^{}\[\]`\\]*\}$')
    quick = F.from_json(F.when(flat, a), T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE", "allowUnquotedFieldNames": "false", "allowSingleQuotes": "false"})
    slow = F.when(flat & quick.isNotNull(), F.lit(None).cast("string")).otherwise(a)
    return F.when(flat & quick.isNotNull(), quick).otherwise(_fields(slow))


def with_fields(df: DataFrame, answer: str, **names: str) -> DataFrame:
    """`df` with a column for each named member: with_fields(df, "raw", said="winner")."""
    read = df.withColumn("_fields", answer_fields(answer))
    return read.withColumns({new: F.try_element_at("_fields", F.lit(member)) for new, member in names.items()}).drop("_fields")
