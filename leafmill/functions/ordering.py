"""Order-dependent work that stays spread out when one group is very large.

A whole group is never sorted or collected as rows in one task. Groups are cut
into runs of ``SPAN`` consecutive order values; each run is handled on its own
and only per-run totals (or finished strings) meet per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1024


def _run(c: Column) -> Column:
    return F.floor(c / F.lit(SPAN)).cast("bigint")


def filter_here(df: DataFrame, condition: Column) -> DataFrame:
    """Filter after the columns the condition reads have been computed.

    Catalyst pushes a plain filter below the projection that computes its input and
    evaluates the input a second time there. A generator stays in place.
    """
    one = F.array(F.lit(0))
    return df.select("*", F.explode(F.when(condition, one)).alias("_here")).drop("_here")


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns whose values later steps read instead of their expressions.

    Catalyst writes a projection's expressions into every place that uses them, which
    grows without bound along a chain of structs. A generator's output is a plain column.
    """
    rest = [c for c in df.columns if c not in columns]
    one = F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))
    return df.select(*rest, F.explode(one).alias("_once")).select(*rest, *[F.col("_once")[k].alias(k) for k in columns])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key. Spark limits each map task to one row per key before
    the shuffle (WindowGroupLimit), so a key with many copies does not pile up."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def running_offset(totals: DataFrame, group: Sequence[str], pos: str, weight: str, out: str) -> DataFrame:
    """Add the sum of ``weight`` over earlier ``pos`` in the group.

    ``totals`` has one row per (group, pos). Runs of positions are summed first,
    so the per-group window sees one row per run only.
    """
    runs = totals.withColumn("_run", _run(F.col(pos)))
    per_run = runs.groupBy(*group, "_run").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_run.select(*group, "_run", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_run_base"))
    inside = Window.partitionBy(*group, "_run").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return (
        runs.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(bases, [*group, "_run"])
        .withColumn(out, (F.col("_run_base") + F.col("_in")).cast("bigint"))
        .drop("_run_base", "_in", "_run")
    )


def dense_position(
    df: DataFrame, group: Sequence[str], major: str, minor: str, tie: Sequence[str], out: str
) -> DataFrame:
    """0-based position of each row in its group by (major, minor, tie).

    Counts per (major, run of minor) give each run its base; a row is ranked only
    inside its own run.
    """
    rows = df.withColumn("_mrun", _run(F.col(minor)))
    per_run = rows.groupBy(*group, major, "_mrun").agg(F.count(F.lit(1)).alias("_n"))
    per_major = per_run.groupBy(*group, major).agg(F.sum("_n").alias("_n"))
    major_base = running_offset(per_major, group, major, "_n", "_major_base").select(*group, major, "_major_base")
    before = Window.partitionBy(*group, major).orderBy("_mrun").rowsBetween(Window.unboundedPreceding, -1)
    run_base = (
        per_run.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(major_base, [*group, major])
        .select(*group, major, "_mrun", (F.col("_before") + F.col("_major_base")).alias("_base"))
    )
    inside = Window.partitionBy(*group, major, "_mrun").orderBy(minor, *tie)
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .join(run_base, [*group, major, "_mrun"])
        .withColumn(out, (F.col("_base") + F.col("_rn") - 1).cast("bigint"))
        .drop("_rn", "_base", "_mrun")
    )


def with_ends(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Marks each group's first and last row by ``order``, which names a row: opens, closes.

    The ends are one row per group, from partial aggregates; they meet the rows on group
    and order, never on the group alone, so a group of any size stays spread out.
    """
    at = F.struct(*order)
    ends = df.groupBy(group).agg(F.min(at).alias("_a"), F.max(at).alias("_z"))
    marks = ends.select(group, "_a", "_z", F.explode(F.array_distinct(F.array("_a", "_z"))).alias("_at"))
    marks = marks.select(group, *[F.col("_at")[c].alias(c) for c in order], (F.col("_at") == F.col("_a")).alias("opens"), (F.col("_at") == F.col("_z")).alias("closes"))
    found = df.join(marks, [group, *order], "left")
    return found.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("opens", "closes")})


def gather_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], *fields: Column | str, out: str = "rows") -> DataFrame:
    """Per group, its rows as an ordered array of structs: the order columns, then the fields.

    Rows move once, to their group; nothing is collected before, and no column moves twice.
    """
    item = F.struct(*order, *fields)
    rows = df.select(*group, item.alias("_item")).repartition(*group)
    return rows.groupBy(*group).agg(F.sort_array(F.collect_list("_item")).alias(out))


def gather(df: DataFrame, group: Sequence[str], order: Sequence[str], **lists: Column) -> DataFrame:
    """Per group, ordered arrays of the given columns (nulls kept as array items)."""
    placed = df.select(*group, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[c.alias(k) for k, c in lists.items()])
    whole = gather_rows(placed, group, [f"_o{i}" for i in range(len(order))], *lists, out="_flat")

    def pick(name: str) -> Column:
        return F.transform("_flat", lambda x: x[name]).alias(name)

    return whole.select(*group, *[pick(k) for k in lists])


def gather_text(df: DataFrame, group: Sequence[str], order: Sequence[str], text: Column, sep: str, out: str) -> DataFrame:
    """Per group, the texts joined in order; each run is joined to one string first.

    Rows move once, to their group; its runs meet there.
    """
    item = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], text.alias("_t"))
    runs = (
        df.select(*group, _run(F.col(order[0])).alias("_run"), item.alias("_item"))
        .repartition(*group)
        .groupBy(*group, "_run")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list("_item")), lambda x: x["_t"]), sep).alias("_part"),
        )
    )
    return runs.groupBy(*group).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_run", "_part"))), lambda x: x["_part"]), sep
        ).alias(out)
    )
