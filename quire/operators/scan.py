"""Running values along a document in two levels, so that one giant document is the work of many tasks.

A document's rows are dealt by document and range; windows run inside a range. A range's sums
and last values are its carry: a row for each range, which one window over the document adds up
and a join brings back. What a task holds is a range, however long the document is. Documents
of one range have no carry, so the join is with few rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions that a range spans.
SPAN = 4096
LEAST = -(1 << 62)


def ranges(pos: str = "pos", span: int = SPAN) -> Column:
    return F.floor(F.col(pos) / span).cast("long")


def keyed(df: DataFrame, key: str, cells: Sequence[Column]) -> tuple[DataFrame, list[str], list[str]]:
    """df with columns that no null hides in: of the key, and of the ranges. A null key is a document too, a null range comes first."""
    kind = dict(df.dtypes)[key]
    own = df.withColumns({"_key": F.coalesce(key, F.lit("0").cast(kind)), "_null": F.col(key).isNull()} | {f"_cell{k}": F.coalesce(c, F.lit(LEAST)) for k, c in enumerate(cells)})
    return own, ["_key", "_null"], [f"_cell{k}" for k in range(len(cells))]


def running(
    df: DataFrame, order: Sequence[str], cells: Sequence[Column], key: str = "doc_id",
    sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, previous: Mapping[str, Column] | None = None, totals: bool = False,
) -> DataFrame:
    """Adds to each row of a document, in the given order: sums up to it (null counts as 0), last values up to it, and previous values before it (nulls passed over).

    cells: the row's range, as columns that rise with the order. totals: adds each sum's total over the document, as <name>_total.
    """
    sums, lasts, previous = dict(sums or {}), dict(lasts or {}), dict(previous or {})
    names, values = [*sums, *lasts, *previous], [*sums.values(), *lasts.values(), *previous.values()]
    own, doc, cell = keyed(df.withColumns({f"_v{k}": v for k, v in enumerate(values)}), key, cells)
    inside, along = Window.partitionBy(*doc, *cell).orderBy(*order), Window.partitionBy(*doc).orderBy(*cell)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier, place = along.rowsBetween(Window.unboundedPreceding, -1), F.struct(*order)
    local, whole, carried = {}, [], [F.count(F.lit(1)).over(earlier).alias("_before")]
    for k, name in enumerate(names):
        v = F.col(f"_v{k}")
        if name in sums:
            local[f"_l{k}"] = F.sum(v).over(upto)
            whole.append(F.sum(v).alias(f"_w{k}"))
            carried.append(F.sum(f"_w{k}").over(earlier).alias(f"_c{k}"))
            carried += [F.sum(f"_w{k}").over(Window.partitionBy(*doc)).alias(f"_t{k}")] * totals
        else:
            local[f"_l{k}"] = F.last(v, ignorenulls=True).over(upto if name in lasts else before)
            whole.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_w{k}"))
            carried.append(F.last(f"_w{k}", ignorenulls=True).over(earlier).alias(f"_c{k}"))
    carry = own.groupBy(*doc, *cell).agg(*whole).select(*doc, *cell, *carried)
    carry = (carry if totals else carry.filter("_before > 0")).drop("_before")
    out = own.withColumns(local).join(carry, [*doc, *cell], "left")
    added = {}
    for k, name in enumerate(names):
        zero = lambda c: F.coalesce(c, F.lit(0))
        added[name] = zero(f"_l{k}") + zero(f"_c{k}") if name in sums else F.coalesce(f"_l{k}", f"_c{k}")
        if name in sums and totals:
            added[f"{name}_total"] = zero(f"_t{k}")
    kept = [c for c in df.columns if c not in added]
    return out.select(*kept, *(c.alias(name) for name, c in added.items()))
