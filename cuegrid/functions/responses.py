"""Reading what a model sent back: text of three response shapes, lenient JSON, cue ids."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from cuegrid.functions import text as T


def content(body: Column) -> Column:
    """The text of a response body, whichever of the three shapes it has; empty where none fits."""
    paths = ("$.candidates[0].content.parts[0].text", "$.choices[0].message.content", "$.content[0].text")
    return F.coalesce(*[F.get_json_object(body, p) for p in paths], F.lit(""))


_DECODER = json.JSONDecoder()


def _wrapped(value):
    return {"translations": value, "items": value} if isinstance(value, list) else value


def _first_value(text: str):
    """The first object or array that a decoder can read from where it opens to the last bracket of its kind; an object that opens first goes before."""
    ends = {"{": "}", "[": "]"}
    for at, kind in sorted((text.index(k), k) for k in ends if k in text):
        try:
            value, stop = _DECODER.raw_decode(text, at)
        except ValueError:
            continue
        if stop == text.rindex(ends[kind]) + 1:  # nothing of the kind behind it
            return _wrapped(value)
    return {}


def read_loosely(said: str):
    """What a model's answer holds: the inside of its first fence if there is one, all of it if that is JSON, else the first value inside."""
    parts = said.strip().split("```")
    if len(parts) > 2:
        inside = parts[1]
        said = inside[4:] if inside[:4].lower() == "json" else inside
    elif len(parts) == 2:  # a fence that isn't closed: its line goes
        said = "\n".join(line for line in said.splitlines() if not line.lstrip().startswith("```"))
    said = said.strip()
    try:
        return _wrapped(json.loads(said))
    except ValueError:
        return _first_value(said)


@pandas_udf(StringType())
def lenient_json(text: pd.Series) -> pd.Series:
    """Canonical JSON of what the text holds: bare arrays are wrapped, {} where there is nothing readable."""
    return text.map(lambda x: json.dumps(read_loosely(x or ""), ensure_ascii=False, sort_keys=True))


def _whole(v: Column) -> Column:
    """A JSON value as a whole number: numbers lose their fraction, texts must be whole numbers, true and false count 1 and 0; null for all else."""
    kind = F.schema_of_variant(v)
    text = T.strip(v.try_cast("string"))
    number = F.when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), v.try_cast("double").cast("long"))
    return number.when(kind == "BIGINT", v.try_cast("long")).when(kind == "BOOLEAN", v.try_cast("boolean").cast("long")).when(
        (kind == "STRING") & text.rlike(r"^[+-]?\d+$"),
        text.try_cast("long"),
    )


def cue_ids(item: Column, default: int = 1) -> Column:
    """Whole numbers from an item's cue_ids, cue_id or id, whether number, text or list: of a list those that are numbers, the default where nothing is."""
    body = F.try_parse_json(item)
    paths = ("$.cue_ids", "$.cue_id", "$.id")
    # a JSON null counts as missing
    given = [F.when(F.schema_of_variant(F.try_variant_get(body, p, "variant")) != "VOID", F.try_variant_get(body, p, "variant")) for p in paths]
    raw = F.coalesce(*given)
    listed = F.array_compact(F.transform(F.try_variant_get(raw, "$", "array<variant>"), _whole))
    found = F.when(F.startswith(F.schema_of_variant(raw), F.lit("ARRAY")), listed).otherwise(F.array_compact(F.array(_whole(raw))))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array(F.lit(default).cast("long")))


def valid_project(x: Column) -> Column:
    return x.rlike(r"^[a-zA-Z0-9_\-]+$")
