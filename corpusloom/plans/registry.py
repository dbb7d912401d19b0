"""Names to plans: every operator applied to its whole input."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import Views

Plan = Callable[[Views], DataFrame]
_PLANS: dict[str, Plan] = {}
_MODULES = ("q_sources", "q_scalars", "q_prose", "q_layout", "q_geometry", "q_catalogue",
            "q_sequences", "q_lookups", "q_editlog", "q_composites")


def plan(fn: Plan) -> Plan:
    """Register a plan under its function name."""
    _PLANS[fn.__name__] = fn
    return fn


def registered() -> list[str]:
    for m in _MODULES:
        import_module(f"{__package__}.{m}")
    return list(_PLANS)


def run_query(name: str, spark: SparkSession, folder: str) -> DataFrame:
    registered()
    return plain_types(_PLANS[name](Views(spark, folder)))


def plain_types(df: DataFrame) -> DataFrame:
    """Widen small integers and floats so results compare across engines."""
    wide = {T.ByteType(): "long", T.ShortType(): "long", T.IntegerType(): "long", T.FloatType(): "double"}
    return df.select(*[F.col(f.name).cast(wide[f.dataType]).alias(f.name) if f.dataType in wide else F.col(f.name)
                       for f in df.schema])
