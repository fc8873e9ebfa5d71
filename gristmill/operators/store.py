"""Chunk store: statistics, consistency between stores, duplicates, and mutations as set rewrites.

Plain Parquet has no in-place updates: every mutation gives the new table, to be written to a new place and swapped in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null

LEVELS = ("grandchild", "child", "flat")


def counters(chunks: DataFrame, columns: list[str], top: int = 20) -> DataFrame:
    """The most common values of each column in one grouped pass; missing counts as unknown, ties by value."""
    filled = chunks.select(*(F.coalesce(blank_to_null(c), F.lit("unknown")).alias(c) for c in columns))
    sets = filled.groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    which = F.lit(None).cast("string")
    for i, c in enumerate(columns):
        which = F.when(F.col("g") == (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)), F.lit(c)).otherwise(which)
    named = sets.select(which.alias("counter"), F.coalesce(*columns).alias("value"), "n")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("counter").orderBy(F.desc("n"), "value")))
    return ranked.filter(F.col("rank") <= top).select("counter", "value", "n")


def by_parent(chunks: DataFrame, parents: DataFrame, parent: str = "parent_id", limit: int | None = None) -> DataFrame:
    """Chunks of every parent by level, and whether the parent document exists; largest first."""
    level = F.col("level")
    kinds = [F.count_if(level == k).alias(k) for k in LEVELS]
    other = F.count_if(~level.isin(*LEVELS) | level.isNull()).alias("other")
    key = F.coalesce(blank_to_null(parent), blank_to_null("source"), F.lit("unknown"))
    sums = chunks.groupBy(key.alias("parent")).agg(*kinds, other, F.count(F.lit(1)).alias("total"))
    known = parents.select(F.col(parent).alias("parent")).distinct().withColumn("has_parent_doc", F.lit(True))
    out = sums.join(known, "parent", "left").withColumn("has_parent_doc", F.coalesce("has_parent_doc", F.lit(False)))
    out = out.orderBy(F.desc("total"), "parent")
    return out.limit(limit) if limit else out


def orphans(chunks: DataFrame, parents: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Keys that only one side has; side names the store that holds them."""
    left, right = chunks.select(parent).filter(F.col(parent).isNotNull()).distinct(), parents.select(parent).distinct()
    alone = left.join(right, parent, "left_anti").withColumn("side", F.lit("chunks"))
    return alone.union(right.join(left, parent, "left_anti").withColumn("side", F.lit("parents")))


def shared_keys(chunks: DataFrame, parents: DataFrame, parent: str = "parent_id") -> DataFrame:
    return chunks.select(parent).intersect(parents.select(parent))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row; null keys don't count."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference doesn't exist."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def preview(chunks: DataFrame, parent_value: Column, parent: str, text: str, limit: int = 1000, length: int = 200) -> DataFrame:
    return chunks.filter(F.col(parent) == parent_value).orderBy("chunk_id").limit(limit).select("chunk_id", F.substring(text, 1, length).alias("preview"))


def upsert(target: DataFrame, changes: DataFrame, key: list[str], insert_only: list[str] = ()) -> DataFrame:
    """Changed rows replace or join the target; ``insert_only`` columns keep the target's value where a row exists.

    ``changes`` has one row a key.
    """
    old, new = target.alias("o"), changes.withColumn("__new", F.lit(True)).alias("n")
    joined = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    fresh = F.col("n.__new").isNotNull()
    known = F.coalesce(*(F.col(f"o.{k}").isNotNull() for k in key))
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        elif c in insert_only:
            out.append(F.when(fresh & ~F.coalesce(known, F.lit(False)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def insert_absent(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The target and those rows (one a key) whose key it lacks."""
    return target.unionByName(rows.dropDuplicates(key).join(target.select(*key).distinct(), key, "left_anti").select(target.columns))


def update_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Guarded update; matched tells which rows it met."""
    met = F.coalesce(condition, F.lit(False))
    return rows.select(*(F.when(met, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns), met.alias("matched"))


def delete_matching(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def purge_counts(chunks: DataFrame, parents_gone: DataFrame, parent: str = "parent_id", levels: tuple[str, ...] = ("grandchild", "child")) -> DataFrame:
    """How many rows of each purged parent a stale delete removes: only the levels it may touch."""
    hit = chunks.filter(F.col("level").isin(*levels)).join(parents_gone.select(parent).distinct(), parent, "left_semi")
    return hit.groupBy(parent).agg(F.count(F.lit(1)).alias("removed"))


def consume_once(states: DataFrame, key: Column, now: Column, expires: str = "expires_at") -> tuple[DataFrame, DataFrame]:
    """The unexpired row that the key takes, and the table without it."""
    taken = F.coalesce(key & (F.col(expires) > now), F.lit(False))
    return states.filter(taken), states.filter(~taken)


def unexpired(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return rows.filter(F.col(expires).isNull() | (F.col(expires) >= now))
