"""Replies that should be JSON with given fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meetlake.functions import text as T


def checked(reply: Column, fields: list[tuple[str, str, bool]]) -> Column:
    """struct(value, fault) of a reply: the fields (name, type, required) of its JSON block, or the first thing that is wrong with it.

    A field that is null counts as missing; one that is there must be of its type. Other fields are left alone.
    """
    block = T.json_block(reply)
    schema = ", ".join(f"`{n}` {kind}" for n, kind, _ in fields)
    value = F.from_json(block, schema)
    fault = F.when(block.isNull() | F.get_json_object(block, "$").isNull(), F.lit("no JSON"))
    for name, kind, required in fields:
        raw = F.get_json_object(block, f"$.{name}")
        wrong = raw.isNotNull() & (F.from_json(block, f"`{name}` {kind}")[name].isNull())
        if required:
            fault = fault.when(raw.isNull(), F.lit(f"{name} is missing"))
        fault = fault.when(wrong, F.lit(f"{name} is not a {kind}"))
    return F.struct(F.when(fault.isNull(), value).alias("value"), fault.alias("fault"))
