"""Arrow UDFs declared by their Arrow type, so that no session is needed when a module is imported."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type


def arrow_fn(result: pa.DataType) -> Callable:
    """Decorator: a function of pa.Array arguments that returns a pa.Array of type result becomes an Arrow UDF."""
    return lambda f: F.arrow_udf(f, from_arrow_type(result))
