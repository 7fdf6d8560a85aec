"""Running values per key that never gather a whole key in one task.

A key's rows are cut into bounded slices along their order. Windows run inside a slice; one
small row per slice carries the state of all earlier slices forward. The slice must be a
deterministic function of the row (for example an ordinal or a time divided by a width).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    part: str,
    *,
    inclusive: bool = True,
    backwards: bool = False,
    **values: tuple[str, Column],
) -> DataFrame:
    """Add running `sum`, `max` or `last` (non-null) columns; `values` is name=(kind, column)."""

    def direction(name: str) -> Column:
        return F.col(name).desc() if backwards else F.col(name).asc()

    reach = 0 if inclusive else -1
    local = (
        Window.partitionBy(*keys, part)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, reach)
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(direction(part))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    place = F.struct(*[F.col(c) for c in order])
    pick = F.min_by if backwards else F.max_by
    over = {
        "sum": lambda c: F.sum(c),
        "max": lambda c: F.max(c),
        "last": lambda c: F.last(c, ignorenulls=True),
    }
    whole = {
        "sum": lambda c: F.sum(c),
        "max": lambda c: F.max(c),
        "last": lambda c: pick(c, F.when(c.isNotNull(), place)),
    }
    rows = frame.withColumns({f"_{n}": over[k](c).over(local) for n, (k, c) in values.items()})
    totals = frame.groupBy(*keys, part).agg(
        *[whole[k](c).alias(f"_whole_{n}") for n, (k, c) in values.items()]
    )
    carried = totals.select(
        *keys,
        part,
        *[over[k](F.col(f"_whole_{n}")).over(earlier).alias(f"_carry_{n}")
          for n, (k, _) in values.items()],
    )
    joined = rows.join(carried, [*keys, part])
    combined = {}
    for n, (kind, _) in values.items():
        near, far = F.col(f"_{n}"), F.col(f"_carry_{n}")
        if kind == "sum":
            combined[n] = F.coalesce(near + far, near, far)
        elif kind == "max":
            combined[n] = F.greatest(near, far)
        else:
            combined[n] = F.coalesce(near, far)
    return joined.withColumns(combined).drop(
        *[f"_{n}" for n in values], *[f"_carry_{n}" for n in values]
    )


def previous(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], part: str, **columns: Column
) -> DataFrame:
    """`lag` by one row for several columns, as new columns."""
    boxed = {f"_box_{n}": ("last", F.struct(c.alias("v"))) for n, c in columns.items()}
    out = running(frame, keys, order, part, inclusive=False, **boxed)
    return out.withColumns({n: F.col(f"_box_{n}")["v"] for n in columns}).drop(*boxed)


def following(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], part: str, **columns: Column
) -> DataFrame:
    """`lead` by one row for several columns, as new columns."""
    boxed = {f"_box_{n}": ("last", F.struct(c.alias("v"))) for n, c in columns.items()}
    out = running(frame, keys, order, part, inclusive=False, backwards=True, **boxed)
    return out.withColumns({n: F.col(f"_box_{n}")["v"] for n in columns}).drop(*boxed)
