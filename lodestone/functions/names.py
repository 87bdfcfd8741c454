"""Which functions of a program are its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that the runtime brings along, matched at their start.
RUNTIME = r"^(?:_|.*@plt|register_tm_clones|deregister_tm_clones|frame_dummy)"
GENERATED = "FUN_"


def is_runtime_name(name: Column) -> Column:
    return name.rlike(RUNTIME)


def is_real_function(name: Column, is_thunk: Column, is_external: Column) -> Column:
    """Neither a thunk, nor runtime, external or a generated name; an unknown external flag means it is not."""
    return ~is_thunk & ~is_runtime_name(name) & ~F.coalesce(is_external, F.lit(False)) & ~name.startswith(GENERATED)
