"""Import cycles, dependency layers and hubs of module graphs, all projects at once.

A graph is a table of edges (`project_id, source, target`): the source module imports the target. Modules are numbered first, so
rounds move pairs of numbers only. Every round is stored and the one before it deleted, and one that changes nothing is the last. A stored
table is judged by its files; Spark would multiply the sizes of frozen ones anew in each join, to numbers of thousands of digits, which the driver keeps. Rounds pass on only
what the last one changed, and join by sorting unless there are `FEW` modules: a broadcast each round would go through the driver, whose memory it fills. Edges stream past the modules'
rows, so a module that very many others import takes time in a task but no memory, and Spark splits its partition if it is skewed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import discard, frozen, stored
from .joins import fits_broadcast, wide_join

#: Rounds of trimming before modules are coloured; chains that are longer are left to the colours.
TRIMS = 3
#: Modules of which a row of two numbers each is broadcast in every round.
FEW = 10_000


def _few(modules: DataFrame) -> bool:
    return fits_broadcast(modules) and modules.count() <= FEW


def _meet(rows: DataFrame, table: DataFrame, keys: list[str], how: str, small: bool) -> DataFrame:
    return rows.join(F.broadcast(table), keys, how) if small else wide_join(rows, table, keys, how)


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`id, project_id, module` of each module, distinct `u, v` of each edge between two modules).

    A module's number is a 63-bit hash; those few that would share one, get the next numbers that are free in their order by name.
    """
    ends = edges.select("project_id", F.explode(F.array("source", "target")).alias("module")).distinct()
    modules = frozen(ends.withColumn("id", F.xxhash64("project_id", "module").bitwiseAND((1 << 62) - 1) * 2))
    shared = modules.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    if shared.take(1):
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("id").orderBy("project_id", "module")) - 1
        modules = frozen(modules.withColumn("id", F.col("id") + place))
    names = modules.select("project_id", F.col("module").alias("source"), F.col("id").alias("u"))
    pairs = edges.filter(F.col("source") != F.col("target")).select("project_id", "source", "target").distinct()
    pairs = wide_join(pairs, names, ["project_id", "source"], "inner")
    pairs = wide_join(pairs, names.toDF("project_id", "target", "v"), ["project_id", "target"], "inner")
    return modules, stored(pairs.select("u", "v"))


def _trimmed(edges: DataFrame, small: bool) -> DataFrame:
    """Edges whose source is imported and whose target imports: others are in no cycle.

    Each round reads the one before three times, so it is stored first: all rounds in one plan would be 27 times one.
    """
    edges = stored(edges)
    for _ in range(TRIMS):
        before = edges
        edges = _meet(before, before.select(F.col("v").alias("u")).distinct(), ["u"], "left_semi", small)
        edges = stored(_meet(edges, before.select(F.col("u").alias("v")).distinct(), ["v"], "left_semi", small).select("u", "v"))
        discard(before)
    return edges


def _least_reaching(edges: DataFrame, small: bool) -> DataFrame:
    """`id, colour`: the least module that reaches each module along the edges, itself included."""
    colours = newest = moved = stored(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("colour", F.col("id")))
    while True:
        sent = _meet(edges.withColumnRenamed("u", "id"), newest, ["id"], "inner", small).groupBy("v").agg(F.min("colour").alias("sent"))
        old, moved = moved, stored(_meet(colours, sent.withColumnRenamed("v", "id"), ["id"], "left", small).select(
            "id", F.least("colour", F.coalesce("sent", "colour")).alias("colour"), (F.col("sent") < F.col("colour")).alias("changed")))
        discard(old)
        colours, newest = moved.select("id", "colour"), moved.filter("changed").select("id", "colour")
        if not moved.filter("changed").take(1):
            return colours


def _reaching_back(inside: DataFrame, roots: DataFrame, small: bool) -> DataFrame:
    """`id, colour` of the modules that reach the root of their colour; ``inside`` are edges between modules of one colour."""
    found = newest = stored(roots)
    while True:
        # Newest modules are few at the end; edges are kept by target.
        met = _meet(inside.withColumnRenamed("v", "id"), newest.select("id"), ["id"], "inner", small)
        last, newest = newest, stored(_meet(met.select(F.col("u").alias("id"), "colour").distinct(), found.select("id"), ["id"], "left_anti", small))
        if last is not found:
            discard(last)
        if not newest.take(1):
            discard(newest)
            return found
        old, found = found, stored(found.unionByName(newest))
        discard(old)


def strong_components(edges: DataFrame, small: bool) -> DataFrame:
    """`id, component` of the modules (`u`, `v`) that lie on a cycle; others are components of their own.

    ``small`` tells whether a row per module may be broadcast in each round.

    Forward colours meet backward reach: a module's colour is the least module that reaches it, and those of one colour that reach it
    back are its component. Components leave, edges between colours leave with them, and the rest is coloured anew.
    """
    left = _trimmed(edges, small)
    done: DataFrame | None = None
    while left.take(1):
        colours = _least_reaching(left, small)
        inside = _meet(left.withColumnRenamed("u", "id"), colours, ["id"], "inner", small).withColumnRenamed("id", "u")
        inside = _meet(inside.withColumnRenamed("v", "id"), colours.withColumnRenamed("colour", "other"), ["id"], "inner", small)
        inside = stored(inside.filter("colour = other").select("u", F.col("id").alias("v"), "colour"))
        found = _reaching_back(inside, colours.filter("id = colour"), small)
        gone = found.select("id")
        rest = _meet(_meet(inside, gone.withColumnRenamed("id", "u"), ["u"], "left_anti", small), gone.withColumnRenamed("id", "v"), ["v"], "left_anti", small)
        old, left = left, _trimmed(rest.select("u", "v"), small)
        discard(old, colours, inside)
        if done is None:
            done = found
        else:
            old, done = done, stored(done.unionByName(found))
            discard(old, found)
    discard(left)
    if done is None:
        return edges.select(F.col("u").alias("id"), F.col("u").alias("component")).limit(0)
    several = done.groupBy("colour").agg(F.count("*").alias("n")).filter("n > 1").select("colour")
    return _meet(done, several, ["colour"], "left_semi", small).select("id", F.col("colour").alias("component"))


def import_cycles(edges: DataFrame) -> DataFrame:
    """`project_id, module, cycle, cycle_size` of the modules that import themselves through others; a cycle is named by its first module."""
    modules, pairs = numbered(edges)
    return named_cycles(modules, strong_components(pairs, _few(modules)))


def named_cycles(modules: DataFrame, components: DataFrame) -> DataFrame:
    members = frozen(wide_join(modules, components, ["id"], "inner"))
    named = members.groupBy("component").agg(F.min("module").alias("cycle"), F.count("*").alias("cycle_size"))
    return wide_join(members, named, ["component"], "inner").select("project_id", "module", "cycle", "cycle_size")


def condensed(pairs: DataFrame, components: DataFrame, small: bool) -> DataFrame:
    """Distinct edges between components, without those inside one."""
    known = components.withColumnRenamed("id", "u")
    out = _meet(pairs, known, ["u"], "left", small).select(F.coalesce("component", "u").alias("a"), "v")
    out = _meet(out, known.withColumnRenamed("u", "v"), ["v"], "left", small).select("a", F.coalesce("component", "v").alias("b"))
    return stored(out.filter("a <> b").distinct())


def _deepest(dag: DataFrame, small: bool) -> DataFrame:
    """`id, layer`: edges on the longest way from each component to one that imports nothing further."""
    layers = newest = moved = stored(dag.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("layer", F.lit(0).cast("long")))
    while True:
        below = _meet(dag.withColumnRenamed("b", "id"), newest, ["id"], "inner", small).groupBy("a").agg((F.max("layer") + 1).alias("up"))
        old, moved = moved, stored(_meet(layers, below.withColumnRenamed("a", "id"), ["id"], "left", small).select(
            "id", F.greatest("layer", "up").alias("layer"), (F.col("up") > F.col("layer")).alias("changed")))
        discard(old)
        layers, newest = moved.select("id", "layer"), moved.filter("changed").select("id", "layer")
        if not moved.filter("changed").take(1):
            return layers


def dependency_layers(edges: DataFrame) -> DataFrame:
    """`project_id, module, cycle, cycle_size, layer` of every module of the edges.

    Modules that import none of their project are layer 0, others lie one above the highest layer they import; the modules of a
    cycle share a layer. A module on no cycle has itself for `cycle`, with size 1.
    """
    modules, pairs = numbered(edges)
    small = _few(modules)
    components = stored(strong_components(pairs, small))
    layers = _deepest(condensed(pairs, components, small), small)
    members = frozen(wide_join(modules, components, ["id"]).withColumn("component", F.coalesce("component", "id")))
    named = members.groupBy("component").agg(F.min("module").alias("cycle"), F.count("*").alias("cycle_size"))
    named = wide_join(named, layers.withColumnRenamed("id", "component"), ["component"]).select(
        "component", "cycle", "cycle_size", F.coalesce("layer", F.lit(0).cast("long")).alias("layer"))
    return wide_join(members, named, ["component"], "inner").select("project_id", "module", "cycle", "cycle_size", "layer")


def degrees(edges: DataFrame) -> DataFrame:
    """`project_id, module, fan_in, fan_out`: the modules that import each module, and those it imports."""
    pairs = edges.filter(F.col("source") != F.col("target")).select("project_id", "source", "target").distinct()
    ends = pairs.select("project_id", F.explode(F.array(
        F.struct(F.col("source").alias("module"), F.lit(0).alias("into"), F.lit(1).alias("out")),
        F.struct(F.col("target").alias("module"), F.lit(1).alias("into"), F.lit(0).alias("out")))).alias("x"))
    return ends.groupBy("project_id", "x.module").agg(F.sum("x.into").alias("fan_in"), F.sum("x.out").alias("fan_out"))


def hubs(edges: DataFrame, log_size: int = 12) -> DataFrame:
    """`project_id, module, fan_in, dependents`: how many modules import each module, directly and in the end.

    Each module holds a theta sketch of the modules that depend on it. Sketches are passed along the edges and merged until none
    grows. A sketch is exact up to 2 ** ``log_size`` modules; beyond, its relative standard error is 2 ** (-``log_size`` / 2). Modules
    on cycles depend on themselves, and are not counted for it.
    """
    modules, pairs = numbered(edges)
    known = newest = moved = stored(pairs.groupBy(F.col("v").alias("id")).agg(F.theta_sketch_agg("u", F.lit(log_size)).alias("sketch")))
    while True:
        passed = wide_join(pairs.withColumnRenamed("u", "id"), newest, ["id"], "inner").select(F.col("v").alias("id"), "sketch", F.lit(False).alias("own"))
        passed = passed.unionByName(known.withColumn("own", F.lit(True)))
        grown = passed.groupBy("id").agg(
            F.theta_union_agg("sketch", F.lit(log_size)).alias("sketch"), F.max(F.when(F.col("own"), F.col("sketch"))).alias("was"))
        old, moved = moved, stored(grown.select("id", "sketch", (F.col("was").isNull() | (F.col("sketch") != F.col("was"))).alias("changed")))
        discard(old)
        known, newest = moved.select("id", "sketch"), moved.filter("changed").select("id", "sketch")
        if not newest.take(1):
            break
    known = known.select("id", F.theta_sketch_estimate("sketch").alias("n"))
    components = strong_components(pairs, _few(modules)).select("id", F.lit(1).alias("itself"))
    direct = pairs.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("fan_in"))
    out = wide_join(wide_join(wide_join(modules, known, ["id"]), direct, ["id"]), components, ["id"])
    return out.select("project_id", "module", F.coalesce("fan_in", F.lit(0).cast("long")).alias("fan_in"),
                      (F.coalesce("n", F.lit(0).cast("long")) - F.coalesce("itself", F.lit(0))).alias("dependents"))
