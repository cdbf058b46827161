"""Text functions the JVM has no built-in for, over Arrow batches."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


@arrow_udf(T.StringType())
def normalized(values: pa.Array) -> pa.Array:
    """Compatibility form with case folded; null stays null."""
    return pa.array([v if v is None else v.lower() if v.isascii() else unicodedata.normalize("NFKC", v).casefold() for v in values.to_pylist()], pa.string())


def headline(title: Column, feed: Column) -> Column:
    """A title for exact comparison: normalised, without white space, and without the name of its own feed at the end; null is empty."""
    text, name = normalized(F.coalesce(title, F.lit(""))), normalized(F.coalesce(feed, F.lit("")))
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    tail = F.concat(F.lit("-"), F.regexp_replace(name, r"(?U)\s+", ""))
    return F.when((F.length(name) > 0) & F.endswith(bare, tail), F.substring(bare, F.lit(1), F.length(bare) - F.length(tail))).otherwise(bare)
