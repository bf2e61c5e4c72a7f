"""Exact selection and bottom-k samples in bounded tasks.

Values are counted first, so ties are one row. A group with more than ``MOST`` distinct values is cut into cells at
quantiles of its distinct values; the exact counts of the cells say which one holds the wanted place, and only that cell
goes on. A pass leaves about one in ``CELLS`` of the distinct values, so a few passes do for any size. No window or sort
ever meets more than ``MOST`` rows of a group, and none of it depends on how good the quantiles are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.plans.staging import ensure_checkpoint_dir, small

#: Distinct values of a group that one task may sort, and cells that a pass cuts larger groups into.
MOST, CELLS = 50_000, 256


def places(rows: DataFrame, value: str, by: list[str], ranks: dict[str, Column], most: int = MOST, cells: int = CELLS) -> DataFrame:
    """``by``, n, and for each name of ``ranks`` the value in that place (from 0) of the group's sorted values.

    A rank is an expression over n, the number of the group's values that are not null; places beyond it give null.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    key = [*by, "_name"]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")).checkpoint()
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("n"), F.count("*").alias("_k")).checkpoint()
    wanted = sizes.select(*by, "_k", F.explode(F.array(*[F.struct(F.lit(k).alias("_name"), r.cast("long").alias("_rank")) for k, r in ranks.items()])).alias("w")).select(*by, "_k", "w.*")
    on = lambda a, b: _on(a, b, by)
    left = on(counts, wanted.where(F.col("_k") <= most)).drop("_k")
    large = wanted.where(F.col("_k") > most).checkpoint()
    current = on(counts, small(large)) if large.limit(1).count() else None
    while current is not None:
        current = current.drop("_k")
        cuts = current.groupBy(*key).agg(F.percentile_approx("_v", F.array(*[F.lit(i / cells) for i in range(1, cells)]), 10_000).alias("_cuts"))
        celled = _on(current, small(cuts), key).withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts").checkpoint()
        tally = celled.groupBy(*key, "_rank", "_cell").agg(F.sum("_c").alias("_s"), F.count("*").alias("_k"))
        upto = F.sum("_s").over(Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # ``cells`` rows at most
        chosen = tally.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_s")))
        chosen = chosen.select(*key, "_cell", "_k", (F.col("_rank") - F.col("_upto") + F.col("_s")).alias("_rank")).checkpoint()
        kept = _on(celled.drop("_rank"), small(chosen), [*key, "_cell"]).drop("_cell")
        left = left.unionByName(kept.where(F.col("_k") <= most).drop("_k").select(left.columns))
        again = chosen.where(F.col("_k") > most).limit(1).count()
        current = kept.where(F.col("_k") > most).select(*key, "_v", "_c", "_rank", "_k").checkpoint() if again else None
    upto = F.sum("_c").over(Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = left.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    found = hit.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in ranks]) if by else hit.agg(*[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in ranks])
    out = sizes.drop("_k")
    return _on(out, found, by, "left") if by else out.crossJoin(found)  # without groups both are one row


def _on(a: DataFrame, b: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Join by ``key``, where null is a value as any."""
    if not key:
        return a.crossJoin(b)  # b has a row for each rank
    right = b.withColumnsRenamed({c: f"_r_{c}" for c in key})
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in key]
    return a.join(right, on, how).drop(*[f"_r_{c}" for c in key])


def hashed(seed: str, id: str = "id") -> Column:
    """The hash that orders a sample: hexadecimal digits."""
    return F.md5(F.concat(F.lit(seed), F.col(id).cast("string")))


def bottom(rows: DataFrame, seed: str, sizes: dict, by: str | None = None, most: int = MOST) -> DataFrame:
    """Of each value of ``by`` in ``sizes`` (of all rows under the key None without ``by``) the so many rows with the least hash of id, or all where there are fewer.

    The hash in the last place is selected exactly; rows below it are in, and only those that share its leading 60 bits are
    ranked by the whole hash and the id.
    """
    lead = F.conv(F.substring(hashed(seed), 1, 15), 16, 10).cast("long")
    group = F.lit(0) if by is None else F.col(by)
    some = rows if by is None else rows.where(F.col(by).isin(list(sizes)))
    keyed = some.withColumns({"_g": group, "_h": lead})
    wanted = F.lit(sizes[None]) if by is None else F.coalesce(*[F.when(F.col("_g") == k, F.lit(n)) for k, n in sizes.items()])
    edge = places(keyed, "_h", ["_g"], {"_edge": F.least(wanted, F.col("n")) - 1}, most).drop("n")
    on = _on(keyed, small(edge), ["_g"]).where(F.col("_h") <= F.col("_edge"))
    inside, last = on.where(F.col("_h") < F.col("_edge")), on.where(F.col("_h") == F.col("_edge"))
    room = _on(edge.select("_g"), inside.groupBy("_g").agg(F.count("*").alias("_in")), ["_g"], "left")
    order = F.row_number().over(Window.partitionBy("_g").orderBy(hashed(seed), "id"))
    fit = _on(last.withColumn("_r", order), small(room), ["_g"]).where(F.col("_r") <= wanted - F.coalesce("_in", F.lit(0)))
    return inside.select(rows.columns).unionByName(fit.select(rows.columns))
