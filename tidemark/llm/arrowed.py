"""Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa


def per_distinct(values: pa.Array, of: Callable, kind: pa.DataType) -> pa.Array:
    """Apply ``of`` once to each distinct value of a batch; nulls stay null."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    coded = values.dictionary_encode()
    made = pa.array([of(x) for x in coded.dictionary.to_pylist()], type=kind)
    return made.take(coded.indices)
