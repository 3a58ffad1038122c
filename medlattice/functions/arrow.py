"""Arrow functions as columns, and the nested arrays that they return."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import ArrowUDFType, arrow_udf


def arrow_type(kind: str) -> pa.DataType:
    """Type of the array that a function returns; made on the driver, as parsing needs its session."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def arrow_column(f: Callable, kind: str, *columns: Column | str) -> Column:
    """An Arrow function of columns that also gets its result's Arrow type.

    It is declared not to be deterministic only so that no filter is pushed through it, which would run it twice.
    """
    made = arrow_type(kind)
    return arrow_udf(lambda *c: f(*c, kind=made), kind, ArrowUDFType.SCALAR).asNondeterministic()(*columns)


def lists(counts: list[int | None], values: pa.Array, kind: pa.DataType) -> pa.Array:
    """A list a document; null where the count is null."""
    n = np.array([c or 0 for c in counts], np.int32)
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    missing = pa.array([c is None for c in counts]) if any(c is None for c in counts) else None
    return pa.ListArray.from_arrays(pa.array(ends), values, type=kind, mask=missing)


def struct(kind: pa.DataType, columns: list[pa.Array]) -> pa.Array:
    return pa.StructArray.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, kind)], fields=list(kind))
