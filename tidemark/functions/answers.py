"""JSON objects in free text, as external services answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def answer_object(text: Column) -> Column:
    """The JSON object of a text as a variant, a fence of code marks around it removed; null for all else."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    parsed = F.try_parse_json(bare)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
