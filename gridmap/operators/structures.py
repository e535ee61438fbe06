"""Nested label documents as rows: walking, merging, ordered distinct values.

A JSON document is walked level by level as VARIANT values, so any nesting and
any keys come out as (path, value) rows.  Objects in lists are merged into one
(their list index is left out of the path), so merging documents is a distinct
over paths and values: keys are united, lists appended if absent, scalars of
one path become a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmap.functions import text as T
from gridmap.session import cut_lineage

_PATH, _VALUE, _PLACE = "path", "value", "place"


def walk_json(df: DataFrame, id_cols, json_col: str) -> DataFrame:
    """Leaves of JSON documents: the id columns, path, place, kind, value.

    ``path`` joins keys by '.', and '[]' stands for any list element; ``place`` joins the list indexes ('' outside lists); ``kind`` is
    string, number, boolean, null, or empty for an empty list or object (value null).  Documents that are no JSON give no rows.
    One round for each level of nesting; each is a generator over the level's containers (no shuffle), and is stored.
    """
    ids = list(id_cols)
    level = (df.select(*ids, F.try_parse_json(F.col(json_col)).alias("v")).where("v is not null")
             .select(*ids, F.lit("").alias(_PATH), F.lit("").alias(_PLACE), "v"))
    leaves = None
    while True:
        kind = F.upper(F.schema_of_variant("v"))
        level = cut_lineage(level.select(*ids, _PATH, _PLACE, "v", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "list")
                                         .when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
                                         .otherwise("number").alias("kind")))
        value = F.when(~F.col("kind").isin("object", "list", "null"), F.try_variant_get("v", "$", "string"))
        found = level.where("kind not in ('object', 'list')").select(*ids, _PATH, _PLACE, "kind", value.alias(_VALUE))
        nested = level.where("kind in ('object', 'list')")
        leaves = found if leaves is None else leaves.unionByName(found)
        if nested.isEmpty():
            return leaves
        inner = nested.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).select("pos", "key", F.col("value").alias("w")), how="left")
        empty = inner.where("w is null").select(*ids, _PATH, _PLACE, F.lit("empty").alias("kind"), F.lit(None).cast("string").alias(_VALUE))
        leaves = leaves.unionByName(empty)
        dotted = F.when(F.col(_PATH) == "", F.col("key")).otherwise(F.concat(F.col(_PATH), F.lit("."), F.col("key")))
        path = F.when(F.col("kind") == "list", F.concat(F.col(_PATH), F.lit("[]"))).otherwise(dotted)
        place = F.when(F.col("kind") == "object", F.col(_PLACE)).when(F.col(_PLACE) == "", F.col("pos").cast("string")).otherwise(
            F.concat(F.col(_PLACE), F.lit("."), F.col("pos").cast("string")))
        level = inner.where("w is not null").select(*ids, path.alias(_PATH), place.alias(_PLACE), F.col("w").alias("v"))


def ordered_distinct(rows: DataFrame, keys, value: str = _VALUE) -> DataFrame:
    """Distinct non-blank values of each key with their position (from 0), in case-insensitive order (then by value).

    Rows are sorted by ranges over (key, value); a value's position is its place in its range plus the number of the key's values in
    earlier ranges.  A key with any number of values is spread over ranges; nothing is gathered by key.
    """
    keys = list(keys)
    one = rows.where(~T.is_blank(value)).select(*keys, value).distinct()
    order = [*keys, "_low", value]
    ranged = one.withColumn("_low", F.lower(value)).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.select(*keys, value, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    first = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    first = first.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    offsets = first.select(*names, F.col("_part").alias("_p"), "_first", "_before")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(offsets, same).select(*keys, (F.col("_before") + F.col("_at") - F.col("_first")).alias("position"), value)


def merge_structures(df: DataFrame, group_cols, json_col: str) -> DataFrame:
    """The union of all documents of a group: group, path, position, value, a row for each distinct non-empty value of a path."""
    return ordered_distinct(walk_json(df, group_cols, json_col), [*group_cols, _PATH])


def vocabulary_json(merged: DataFrame, group_cols, most: int | None = None) -> DataFrame:
    """(group, json): the merged structure of each group as an object of path -> list of values, for configuration-sized groups.

    ``most``: values a path shows at most (None: all).
    """
    groups = list(group_cols)
    shown = merged if most is None else merged.where(F.col("position") < most)
    lists = shown.groupBy(*groups, _PATH).agg(F.array_sort(F.collect_list(F.struct("position", _VALUE))).alias("v"))
    pairs = lists.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(_PATH, F.transform("v", lambda x: x[_VALUE]).alias("v")))).alias("p"))
    return pairs.select(*groups, F.to_json(F.map_from_entries("p")).alias("json"))
