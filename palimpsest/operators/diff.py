"""Differences: working tree against index, tree against tree, keyed lists, tiles and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan_status(working: DataFrame, index: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, status): U in the working tree only, M where contents differ, D in the index only."""
    a = working.select(path, F.col(content).alias("__now"), F.lit(True).alias("__here"))
    b = index.select(path, F.col(content).alias("__then"), F.lit(True).alias("__known"))
    status = F.when(F.col("__known").isNull(), "U").when(F.col("__here").isNull(), "D").when(~F.col("__now").eqNullSafe(F.col("__then")), "M")
    return a.join(b, path, "full_outer").select(path, status.alias("status")).where("status is not null")


def needs_hash(size: Column, mtime: Column, old_size: Column, old_mtime: Column, index_mtime: Column) -> Column:
    """Whether a file must be read: unless size and time are unchanged, not both zero, and older than the index."""
    same = size.eqNullSafe(old_size) & mtime.eqNullSafe(old_mtime)
    return ~(same & ~((size == 0) & (mtime == 0)) & (mtime < index_mtime))


def tree_changes(current: DataFrame, target: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, status, content): what turns `current` into `target`; A and M rewrite, D deletes. Null-safe."""
    a = current.select(path, F.col(content).alias("__old"), F.lit(True).alias("__had"))
    b = target.select(path, F.col(content).alias("__new"), F.lit(True).alias("__has"))
    status = F.when(F.col("__had").isNull(), "A").when(F.col("__has").isNull(), "D").when(~F.col("__new").eqNullSafe(F.col("__old")), "M")
    return a.join(b, path, "full_outer").select(path, status.alias("status"), F.col("__new").alias("content")).where("status is not null")


def keyed_list_diff(old: DataFrame, new: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Pairs the nth occurrence of a key on one side with the nth on the other; before, after, change and pos.

    Rows come in the order of the new list, then what is left of the old one.
    """
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    a = old.select(*key, nth.alias("nth"), F.col(value).alias("before"), F.col(order).alias("__old"))
    b = new.select(*key, nth.alias("nth"), F.col(value).alias("after"), F.col(order).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("modified")
    return a.join(b, [*key, "nth"], "full_outer").select(*key, "nth", "before", "after", change.alias("change"), F.coalesce("__new", "__old").alias("pos"))


def changed_entries(old: DataFrame, new: DataFrame, tile: int) -> DataFrame:
    """Entries of `new` whose tiles differ: (entry, new_tiles, changed_tiles, x0, y0, x1, y1), box null where only tiles went.

    Sides are (entry, x, y, hash). An entry that is gone altogether is not reported.
    """
    was = old.select("entry", "x", "y", F.col("hash").alias("__was"))
    joined = new.join(was, ["entry", "x", "y"], "left").withColumn("__differs", ~F.col("hash").eqNullSafe(F.col("__was")))
    at = lambda c: F.when(F.col("__differs"), F.col(c))
    counted = joined.groupBy("entry").agg(
        F.count(F.lit(1)).alias("new_tiles"),
        F.count_if("__differs").alias("changed_tiles"),
        F.min(at("x")).alias("x0"),
        F.min(at("y")).alias("y0"),
        (F.max(at("x")) + tile).alias("x1"),
        (F.max(at("y")) + tile).alias("y1"),
    )
    before = old.groupBy("entry").agg(F.count(F.lit(1)).alias("__old_tiles"))
    found = counted.join(before, "entry", "left")
    return found.where("changed_tiles > 0 or new_tiles <> coalesce(__old_tiles, 0)").drop("__old_tiles")


def region(width: int, height: int) -> list[Column]:
    """The box of changed_entries as shares of a canvas: x and y from 0, width and height within 0 and 1."""
    x, y = F.greatest(F.lit(0.0), F.col("x0") / width), F.greatest(F.lit(0.0), F.col("y0") / height)
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return [x.alias("x"), y.alias("y"), share((F.col("x1") - F.col("x0")) / width).alias("w"), share((F.col("y1") - F.col("y0")) / height).alias("h")]


def bounds(tiles: DataFrame, tile: int) -> DataFrame:
    """The painted box of each entry."""
    return tiles.groupBy("entry").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + tile).alias("x1"), (F.max("y") + tile).alias("y1"))


def layer_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(place, id, name, change, details) of layers (pos, uuid, name, opacity, blend), changed ones only: by id, each new layer
    against the first old one. New layers come in their order, then removed ones in theirs; visibility does not count."""
    keyed = lambda side: side.withColumn("id", F.coalesce(F.nullif(F.col("uuid"), F.lit("")), F.col("name")))
    old, new = keyed(old), keyed(new)
    first = old.groupBy("id").agg(F.min_by(F.struct("name", "opacity", "blend"), "pos").alias("o"))
    both = new.join(first, "id", "left")
    step = lambda label, c: F.when(~F.col(f"o.{c}").eqNullSafe(F.col(c)), F.concat(F.lit(f"{label} "), F.coalesce(F.col(f"o.{c}").cast("string"), F.lit("")), F.lit(" -> "), F.coalesce(F.col(c).cast("string"), F.lit(""))))
    details = F.array_compact(F.array(step("opacity", "opacity"), step("blend", "blend"), step("renamed", "name")))
    none = F.array().cast("array<string>")
    change = F.when(F.col("o").isNull(), "added").when(F.size(details) > 0, "modified")
    there = both.select(F.struct(F.lit(0).alias("side"), "pos").alias("place"), "id", "name", change.alias("change"), F.when(F.col("o").isNull(), none).otherwise(details).alias("details"))
    gone = old.join(new.select("id").distinct(), "id", "left_anti")
    gone = gone.select(F.struct(F.lit(1).alias("side"), "pos").alias("place"), "id", "name", F.lit("removed").alias("change"), none.alias("details"))
    return there.where("change is not null").unionByName(gone)


def three_way(base: DataFrame, current: DataFrame, source: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, status, content) of a merge: A, M, D, or C where both sides changed (the source wins unless it deleted)."""
    side = lambda df, name: df.select(path, F.col(content).alias(name))
    every = side(base, "b").join(side(current, "c"), path, "full_outer").join(side(source, "s"), path, "full_outer")
    b, c, s = F.col("b"), F.col("c"), F.col("s")
    conflict = ~c.eqNullSafe(b)
    status = F.when(s.isNotNull(), F.when(conflict, "C").when(c.isNotNull(), "M").otherwise("A")).when(c.isNotNull(), F.when(conflict, "C").otherwise("D"))
    settled = every.where(~(s.eqNullSafe(c) | s.eqNullSafe(b)))
    kept = F.coalesce(s, F.when(conflict, c))
    return settled.select(path, status.alias("status"), kept.alias("content")).where("status is not null")


def unchanged_layers(incoming: DataFrame, ancestor: DataFrame) -> DataFrame:
    """Layers (uuid, signature, tile) of `incoming` whose signature and multiset of tiles equal an ancestor layer's."""
    packed = lambda df: df.groupBy("uuid", "signature").agg(F.array_sort(F.collect_list("tile")).alias("tiles"))
    return packed(incoming).join(packed(ancestor), ["uuid", "signature", "tiles"], "left_semi").select("uuid", "signature", F.size("tiles").cast("bigint").alias("tiles"))
