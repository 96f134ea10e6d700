"""Style cascade: basedOn closure and last-non-null merge, theme slots, usage, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closure(styles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, style, ancestor, depth, cyclic): each style with itself and its ancestors, nearest first, inside one document of the keys `by`.

    A chain ends where it would meet a style again (cyclic marks that row) or where its
    parent is not defined; chains have no greatest length. Chains are walked in a map of
    one document's styles, which is bounded by the part that holds them, so a single
    shuffle by document does it. An id defined twice has the least of its parents.
    """
    keys = list(by)
    parents = styles.where("id is not null").groupBy(*keys, "id").agg(F.min("based_on").alias("based_on"))
    up = parents.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("id", "based_on"))).alias("up"))

    def step(path: Column, _: Column) -> Column:
        onward = F.element_at(F.col("up"), F.element_at(path, -1))
        more = onward.isNotNull() & F.map_contains_key("up", F.coalesce(onward, F.lit(""))) & ~F.coalesce(F.array_contains(path, onward), F.lit(False))
        return F.when(more, F.array_append(path, onward)).otherwise(path)

    rows = up.select(*keys, "up", F.explode(F.map_keys("up")).alias("style"))
    rows = rows.withColumn("path", F.aggregate(F.sequence(F.lit(1), F.size("up")), F.array("style"), step))
    rows = rows.select(*keys, "style", "up", "path", F.posexplode("path").alias("depth", "ancestor"))
    cyclic = F.expr("array_contains(slice(path, 1, depth + 1), element_at(up, ancestor))")
    return rows.select(*keys, "style", "ancestor", "depth", F.coalesce(cyclic, F.lit(False)).alias("cyclic"))


def resolve(styles: DataFrame, fields: list[str], defaults: dict[str, object] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(*by, id, *fields): of each field the nearest value that is set, else the default. False is a value, null is none."""
    keys = list(by)
    chain = closure(styles, by).join(styles.select(*keys, F.col("id").alias("ancestor"), *fields), [*keys, "ancestor"])
    nearest = [F.coalesce(F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("depth"))), F.lit((defaults or {}).get(f))).alias(f) for f in fields]
    return chain.groupBy(*keys, F.col("style").alias("id")).agg(*nearest)


def usage(styles: DataFrame, paragraphs: DataFrame, default_style: str | None = None) -> DataFrame:
    """(id, name, usage_count): paragraphs without a known style count for the default one. A broadcast of styles is left to the optimizer."""
    known = styles.select(F.col("id").alias("style_id"), F.lit(True).alias("known"))
    counted = paragraphs.join(known, "style_id", "left").select(F.when(F.col("known"), F.col("style_id")).otherwise(F.lit(default_style)).alias("id")).groupBy("id").agg(F.count("*").alias("usage_count"))
    return styles.select("id", "name").join(counted, "id", "left").select("id", "name", F.coalesce("usage_count", F.lit(0)).alias("usage_count"))


def collisions(declared: DataFrame, existing: DataFrame, aliases: DataFrame) -> DataFrame:
    """(declared_id, existing_id, name): names that are the same once their aliases are made one, under different ids."""
    canon = lambda d, kind: d.where("name is not null").join(aliases, d["name"] == aliases["alias"], "left").select(F.col("id").alias(f"{kind}_id"), F.lower(F.coalesce("canonical", "name")).alias("name"))
    return canon(declared, "declared").join(canon(existing, "existing"), "name").where("declared_id <> existing_id").select("declared_id", "existing_id", "name")


def theme_value(attr: Column, literal: Column, slots: DataFrame | dict[str, str]) -> Column:
    """A themed attribute beats the literal on the same element; an unknown slot falls back to it."""
    table = F.create_map(*[F.lit(x) for kv in slots.items() for x in kv])
    return F.coalesce(F.element_at(table, attr), literal)


def delta(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field, old, new) where a field changed."""
    long = lambda d, as_: d.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(as_)) for f in fields])).alias("x")).select("id", f"x.field", f"x.{as_}")
    return long(after, "new").join(long(before, "old"), ["id", "field"], "left").where("not (old <=> new)")


def versus_direct(declared: DataFrame, direct: DataFrame, fields: list[str]) -> DataFrame:
    """(style_id, field, overridden, redundant, first_override): direct formatting of a style's paragraphs against the style."""
    long = lambda d, key, as_: d.select(*key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(as_)) for f in fields])).alias("x")).select(*key, "x.field", f"x.{as_}")
    both = long(direct, ["style_id", "para_seq"], "own").where("own is not null").join(long(declared, ["style_id"], "want"), ["style_id", "field"]).where("want is not null")
    num = lambda c: F.expr(f"try_cast({c} as double)")
    same = F.coalesce(F.abs(num("own") - num("want")) < 1e-6, F.col("own") == F.col("want"))
    return both.withColumn("same", same).groupBy("style_id", "field").agg(F.count_if(~F.col("same")).alias("overridden"), F.count_if("same").alias("redundant"), F.min_by("own", F.when(~F.col("same"), F.col("para_seq"))).alias("first_override"))
