"""Trees of modules as parent-child tables: full parameter names, and those outside modules of some types.

``modules``: id, parent (null for the root), name (in its parent), type.  ``params``: module (an id), name.

The way from every module to the root is found by doubling: after k rounds each module knows an ancestor 2**k levels
up and the names and types in between, so a tree of depth d takes about log2(d) joins, however many modules it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.ordering import checkpointed


def module_paths(modules: DataFrame, forbidden: Sequence[str] = ()) -> DataFrame:
    """id, path (names from below the root, joined by dots; the root's is empty), hidden (a module on the way is of a forbidden type).

    The root's own type does not count.  A parent that is not there, two rows of one id, or a cycle is an error.
    """
    own = modules.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), "").otherwise(F.col("name")).alias("path"), (F.col("parent").isNotNull() & F.col("type").isin(list(forbidden))).alias("hidden"))
    own = checkpointed(own)
    n, distinct = own.agg(F.count("*"), F.countDistinct("id")).collect()[0]
    lost = own.where("up is not null").join(own.select(F.col("id").alias("up")), "up", "left_anti").limit(1).count()
    if distinct != n or lost:
        raise ValueError("ids of modules must differ, and parents must be there")
    rounds = 0
    while own.where("up is not null").limit(1).count():
        if rounds > n.bit_length():  # the longest way has n - 1 steps
            raise ValueError("modules that contain each other")
        above = own.select(F.col("id").alias("up"), F.col("up").alias("higher"), F.col("path").alias("head"), F.col("hidden").alias("shut"))
        open_ = own.where("up is not null").join(above, "up")
        path = F.when(F.col("head") == "", F.col("path")).otherwise(F.concat_ws(".", "head", "path"))
        moved = open_.select("id", F.col("higher").alias("up"), path.alias("path"), (F.col("hidden") | F.col("shut")).alias("hidden"))
        own = checkpointed(own.where("up is null").unionByName(moved))
        rounds += 1
    return own.select("id", "path", "hidden")


def parameter_names(modules: DataFrame, params: DataFrame, forbidden: Sequence[str] = ()) -> DataFrame:
    """name: full names of the parameters that are not in or below a module of a forbidden type; the root's own always count."""
    paths = module_paths(modules, forbidden).where("NOT hidden").select(F.col("id").alias("module"), "path")
    rows = params.join(paths, "module")
    return rows.select(F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(".", "path", "name")).alias("name"))


def decay_names(modules: DataFrame, params: DataFrame, norm_types: Sequence[str]) -> DataFrame:
    return parameter_names(modules, params, norm_types).where(~F.contains("name", F.lit("bias")))
