"""Flow paths over a grid, their scores and the choice of distinct ones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scarpline.operators.grid import D8, d8_neighbours


def next_cells(cells: DataFrame, downstream: bool = True, step: int = 1) -> DataFrame:
    """The steepest of eight neighbours of each cell that has all of them: (tile, row, col, n_row, n_col, slope, length).

    Direct neighbours come from two windows, over rows and over columns, so no cell is multiplied; farther ones by a join.
    """
    if step != 1:
        slopes = d8_neighbours(cells, step)
        steep = F.col("slope") if downstream else -F.col("slope")
        best = slopes.withColumn("s", steep).groupBy("tile", "row", "col").agg(F.count("*").alias("n"), F.min(F.struct("s", "dir", "n_row", "n_col", "slope", "length")).alias("m")).filter("n = 8")
    else:
        across, down = Window.partitionBy("tile", "row").orderBy("col"), Window.partitionBy("tile", "col").orderBy("row")
        beside = lambda k, c, of, w: F.when(F.lead(c, k).over(w) == F.col(c) + k, F.lead(of, k).over(w))
        cell = F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "z")
        wide = cells.select("tile", "row", "col", "z", cell.alias("own")).select("*", beside(-1, "col", "own", across).alias("w"), beside(1, "col", "own", across).alias("e"))
        wide = wide.withColumn("three", F.struct("w", "own", "e"))
        wide = wide.select("tile", "row", "col", "z", "w", "e", beside(-1, "row", "three", down).alias("n"), beside(1, "row", "three", down).alias("s"))
        around = [F.col(c) for c in ("e", "s.e", "s.own", "s.w", "w", "n.w", "n.own", "n.e")]
        lengths = [math.hypot(*d) for d in D8]
        slope = lambda c, length: (c["z"] - F.col("z")) / length
        ways = [F.struct((slope(c, x) if downstream else -slope(c, x)).alias("s"), F.lit(k).alias("dir"), c["row"].alias("n_row"), c["col"].alias("n_col"), slope(c, x).alias("slope"), F.lit(x).alias("length")) for k, (c, x) in enumerate(zip(around, lengths))]
        all_there = F.lit(True)
        for c in around:
            all_there = all_there & c.isNotNull()
        best = wide.filter(all_there).select("tile", "row", "col", F.array_min(F.array(*ways)).alias("m"))
    return best.select("tile", "row", "col", "m.n_row", "m.n_col", "m.slope", "m.length")


def _union(first: DataFrame, *more: DataFrame | None) -> DataFrame:
    for part in more:
        first = first if part is None else first.union(part)
    return first


def d8_paths(cells: DataFrame, starts: DataFrame, downstream: bool = True, max_steps: int = 50, min_slope_degrees: float = 7.0, tolerance: int = 1, cut_every: int = 8) -> DataFrame:
    """IT-1: from each start (path_id, tile, row, col) the walk to the steepest neighbour: path_id, steps, stop_reason, cells.

    One join a step over all paths at once. It stops at an edge, on a slope of the wrong sign beyond the minimum, at a
    visited cell, after more flat steps in a row than tolerated, or after max_steps. A long walk's lineage is cut.
    """
    from scarpline.operators.scratch import by_size, checkpointed

    follow = by_size(checkpointed(next_cells(cells, downstream)))
    here = lambda r, c: F.struct(F.col(r).cast("int").alias("row"), F.col(c).cast("int").alias("col"))
    walk = starts.select("path_id", "tile", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).withColumns({"cells": F.array(here("row", "col")), "flat": F.lit(0), "stop": F.lit(None).cast("string")})
    done, parts = None, []
    degrees = F.degrees(F.atan(F.col("slope")))
    sign = -1 if downstream else 1
    for step in range(1, max_steps + 1):
        moved = walk.join(follow, ["tile", "row", "col"], "left")
        is_flat = F.abs(degrees) < min_slope_degrees
        to = here("n_row", "n_col")
        flat = F.when(is_flat, F.col("flat") + 1).otherwise(0)
        stop = F.when(F.col("slope").isNull(), "edge_reached").when(~is_flat & (degrees * sign < 0), "greater_than_tolerance_opposite_flow").when(F.array_contains("cells", to), "loop_detected").when(flat > tolerance, "invalid_steps_tolerance_reached")
        moved = moved.withColumns({"stop": stop, "flat": flat})
        ended = moved.filter("stop IS NOT NULL").select("path_id", "cells", "stop")
        done = ended if done is None else done.union(ended)
        walk = moved.filter("stop IS NULL").select("path_id", "tile", F.col("n_row").alias("row"), F.col("n_col").alias("col"), F.concat("cells", F.array(to)).alias("cells"), "flat", "stop")
        if step % cut_every == 0:
            # what has ended is stored once, not again at each cut
            parts, done, walk = [*parts, checkpointed(done)], None, checkpointed(walk)
            if walk.isEmpty():
                break
    rest = walk.select("path_id", "cells", F.lit("max_runout").alias("stop"))
    return _union(rest, *parts, done).select("path_id", (F.size("cells") - 1).alias("steps"), F.col("stop").alias("stop_reason"), "cells")


def top_paths(paths: DataFrame, n: int, by: str = "start") -> DataFrame:
    """IT-5: the n paths of best score of each start."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "path_id"))
    return paths.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def realism_score(valid, deviation, mean_slope, length, stop, min_degrees: float = 7.0):
    """IT-3: of mean validity, mean deviation, mean slope (degrees), plane length and stop reason, from 0 up."""
    penalty = F.when(stop.isin("loop_detected", "edge_reached"), 3).when(stop.isin("greater_than_tolerance_opposite_flow", "invalid_steps_tolerance_reached", "low_realism"), 2).when(stop.isin("max_runout", "max_paths"), 1).otherwise(0)
    return F.greatest(F.lit(0.0), 90 * valid + F.least(length / 5, F.lit(10.0)) - 2 * penalty - 5 * deviation - F.least(F.lit(60.0), F.greatest(F.lit(0.0), 5 * (min_degrees - F.abs(mean_slope)))))


def separate_paths(paths: DataFrame, k: int = 5, tolerance: float = 0.5) -> DataFrame:
    """MO-5: greedy choice of up to k paths (start, path_id, score, cells) of each start, best score first.

    A path is taken if it shares no more than tolerance of the smaller cell set (without the first cell) with any taken
    one. The fold runs over a start's paths by score in one array.
    """
    row = F.struct((-F.col("score")).alias("s"), "path_id", F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))).alias("cells"))
    listed = paths.groupBy("start").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    overlap = lambda a, b: F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(0)), F.lit(0.0))
    taken = F.aggregate("rows", F.slice("rows", 1, 0), lambda acc, r: F.when((F.size(acc) < k) & ~F.exists(acc, lambda t: overlap(t["cells"], r["cells"]) > tolerance), F.concat(acc, F.array(r))).otherwise(acc))
    return listed.select("start", F.posexplode(taken).alias("rank", "t")).select("start", (F.col("rank") + 1).alias("rank"), "t.path_id", (-F.col("t.s")).alias("score"))


def gradient_paths(cells: DataFrame, starts: DataFrame, downstream: bool = True, reach: int = 1, max_steps: int = 50, min_slope_degrees: float = 7.0, tolerance: int = 1, spacing: float = 1.0, cut_every: int = 3) -> DataFrame:
    """IT-2: walks down (or up) the gradient of central differences: path_id, steps, stop_reason, cells, validity, deviation.

    The place moves on by 10 spacings x reach x gradient, not rounded; the path takes the nearest cell. It stops where it
    leaves the grid or has no gradient, comes back to a cell, or takes more steps in a row below the minimum slope than
    tolerated. deviation is the angle, in units of 45 degrees, between the gradient and the way from the last cell.
    """
    from scarpline.operators.grid import point_gradients
    from scarpline.operators.scratch import by_size, checkpointed

    size = cells.groupBy("tile").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    follow = by_size(checkpointed(point_gradients(cells, reach, spacing, spacing).select("tile", "row", "col", "gx", "gy").join(size, "tile")))
    cell = lambda r, c: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"))
    none = F.array().cast
    walk = starts.select("path_id", "tile", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    walk = walk.withColumns({"px": F.col("col").cast("double"), "py": F.col("row").cast("double"), "cells": F.array(cell(F.col("row"), F.col("col"))), "flat": F.lit(0), "valid": none("array<boolean>"), "deviation": none("array<double>")})
    keys, done, parts = ["path_id", "cells", "valid", "deviation"], None, []
    sign, least = (-1 if downstream else 1), F.tan(F.radians(F.lit(min_slope_degrees)))
    for step in range(1, max_steps + 1):
        moved = walk.join(follow, ["tile", "row", "col"], "left")
        # in cells; rows run down the page as y does in the gradient
        moved = moved.withColumns({"px": F.col("px") + 10 * reach * sign * F.col("gx"), "py": F.col("py") + 10 * reach * sign * F.col("gy")})
        out = F.col("gx").isNull() | F.col("gy").isNull() | ~F.col("px").between(0, F.col("last_col")) | ~F.col("py").between(0, F.col("last_row"))
        off = F.atan2(sign * F.col("gy"), sign * F.col("gx")) - F.atan2(F.col("py") - F.col("row"), F.col("px") - F.col("col"))
        small = F.hypot("gx", "gy") < least
        moved = moved.withColumns({"n_row": F.floor(F.col("py") + 0.5).cast("int"), "n_col": F.floor(F.col("px") + 0.5).cast("int"), "now_flat": F.when(small, F.col("flat") + 1).otherwise(0), "out": F.coalesce(out, F.lit(True))})
        moved = moved.withColumns({"valid": F.when(F.col("out"), F.col("valid")).otherwise(F.concat("valid", F.array(~small))), "deviation": F.when(F.col("out"), F.col("deviation")).otherwise(F.concat("deviation", F.array(F.abs(F.atan2(F.sin(off), F.cos(off))) / F.radians(F.lit(45.0)))))})
        to = cell(F.col("n_row"), F.col("n_col"))
        moved = moved.withColumn("stop", F.when(F.col("out"), "edge_reached").when(F.array_contains("cells", to), "loop_detected").when(F.col("now_flat") > tolerance, "invalid_steps_tolerance_reached"))
        ended = moved.filter("stop IS NOT NULL").select(*keys, "stop")
        done = ended if done is None else done.union(ended)
        walk = moved.filter("stop IS NULL").select("path_id", "tile", F.col("n_row").alias("row"), F.col("n_col").alias("col"), "px", "py", F.concat("cells", F.array(to)).alias("cells"), F.col("now_flat").alias("flat"), "valid", "deviation")
        if step % cut_every == 0:
            # what has ended is stored once, not again at each cut
            parts, done, walk = [*parts, checkpointed(done)], None, checkpointed(walk)
            if walk.isEmpty():
                break
    found = _union(walk.select(*keys, F.lit("max_runout").alias("stop")), *parts, done)
    return found.select("path_id", (F.size("cells") - 1).alias("steps"), F.col("stop").alias("stop_reason"), "cells", F.col("valid").alias("validity"), "deviation")


def partial_score(valid, deviation, mean_slope, min_degrees: float = 7.0):
    """IT-4: the score of a path on its way, of the means of validity, deviation and slope (degrees) by step: 70 at best."""
    return F.greatest(F.lit(0.0), 70 * valid - 5 * deviation - F.least(F.lit(60.0), F.greatest(F.lit(0.0), 5 * (min_degrees - F.abs(mean_slope)))))


def scored_paths(found: DataFrame, min_degrees: float = 7.0) -> DataFrame:
    """IT-3, AG-10: adds mean_validity, mean_deviation, mean_slope, length and score to compatible_paths(); a path without a step has means of 0."""
    mean = lambda c: F.coalesce(F.col(f"sums.{c}") / F.nullif("steps", F.lit(0)), F.lit(0.0))
    out = found.withColumns({"mean_validity": mean("validity"), "mean_deviation": mean("deviation"), "mean_slope": mean("slope"), "length": F.col("sums.length")}).drop("sums")
    return out.withColumn("score", realism_score(F.col("mean_validity"), F.col("mean_deviation"), F.col("mean_slope"), F.col("length"), F.col("stop_reason"), min_degrees))


def compatible_paths(cells: DataFrame, starts: DataFrame, downstream: bool = True, max_steps: int = 50, min_slope_degrees: float = 7.0, tolerance: int = 1, opposite_low: bool = False, maximum_paths: int | None = 50_000, min_partial_score: float | None = None) -> DataFrame:
    """IT-4: all simple paths over neighbours whose slope is compatible with the flow: path_id, steps, stop_reason, cells, validity, deviation, slopes, lengths, and the sums of these.

    A frontier of paths grows by one step a round, by one join; every path ends as max_runout, edge_reached,
    greater_than_tolerance_opposite_flow (no compatible neighbour), invalid_steps_tolerance_reached, or, from four steps (or the tolerance) on,
    low_realism where its partial score is below min_partial_score. Where all ways on are visited or beyond the tolerance of flat steps,
    nothing is returned. The number of paths grows by up to eight a step: a partial score keeps those of a start few, and once a start has
    maximum_paths, ended ones and those of the frontier, its frontier ends as max_paths. Each round makes and stores what ends in it and what goes
    on at once, and sums run along, so no array is summed again.
    """
    from scarpline.operators.scratch import checkpointed

    least = F.tan(F.radians(F.lit(min_slope_degrees)))
    sign = -1 if downstream else 1
    slopes = d8_neighbours(cells).withColumn("s", F.col("slope") * sign)
    low = F.abs("s") < least if opposite_low else (F.col("s") < least) & (F.col("s") >= 0)
    ways = slopes.withColumns({"good": F.col("s") >= least, "low": low, "degrees": F.degrees(F.atan("slope"))})
    # paths are stored once a round, so a step is a number for its cell, one for its way, and its slope
    packed = lambda row, col: F.shiftleft(F.col(row).cast("long"), 32).bitwiseOR(F.col(col).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    way = F.struct(F.col("dir").cast("int").alias("dir"), "good", "low", "degrees", "length", packed("n_row", "n_col").alias("to"))
    follow = ways.groupBy("tile", "row", "col").agg(F.count("*").alias("n"), F.max_by("dir", F.struct("s", -F.col("dir"))).alias("steepest"), F.bool_or("good").alias("any_good"), F.bool_or("low").alias("any_low"), F.collect_list(F.when(F.col("good") | F.col("low"), way)).alias("ways"))
    follow = checkpointed(follow)
    row_of, col_of = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: F.shiftright(F.shiftleft(c, 32), 32).cast("int"))
    aside = lambda turn: F.least(turn, 8 - turn).cast("double")
    kinds = ["validity", "deviation", "slope", "length"]
    sums = F.struct(*[F.lit(0.0).alias(k) for k in kinds])
    walk = starts.select("path_id", "tile", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).withColumns({"path": F.array(packed("row", "col")), "flat": F.lit(0), "ways_taken": F.array().cast("array<tinyint>"), "slopes": F.array().cast("array<double>"), "sums": sums})
    keys, parts, ended_counts = ["path_id", "path", "ways_taken", "slopes", "sums"], [], None
    low_score = F.lit(False)
    if min_partial_score is not None:
        means = [F.col(f"sums.{k}") / F.nullif(F.size("slopes"), F.lit(0)) for k in kinds[:3]]
        low_score = (F.size("slopes") >= max(4, tolerance)) & (partial_score(*means, min_slope_degrees) < min_partial_score - 1e-9)
    for _ in range(max_steps):
        met = walk.join(follow, ["tile", "row", "col"], "left")
        stop = F.when(F.col("n").isNull() | (F.col("n") < 8), "edge_reached").when(~F.col("any_good") & ~F.col("any_low"), "greater_than_tolerance_opposite_flow").when(~F.col("any_good") & (F.col("flat") == tolerance), "invalid_steps_tolerance_reached").when(low_score, "low_realism")
        # what ends stays one row beside the ways on of the others
        goes = F.col("stop").isNull()
        on = met.withColumn("stop", stop).withColumn("w", F.explode(F.when(goes, F.col("ways")).otherwise(F.array(F.lit(None)))))
        on = on.withColumns({"to": F.col("w.to"), "now_flat": F.when(F.col("w.low"), F.col("flat") + 1).otherwise(0), "turn": F.abs(F.col("w.dir") - F.col("steepest")).cast("int")})
        on = on.filter(~goes | (~F.array_contains("path", F.col("to")) & (F.col("now_flat") <= tolerance)))
        more = lambda name, value: F.when(goes, F.concat(name, F.array(value))).otherwise(F.col(name)).alias(name)
        code = (F.col("w.dir") * 16 + F.col("turn") * 2 + F.col("w.good").cast("int")).cast("tinyint")
        added = zip(kinds, (F.col("w.good").cast("double"), aside(F.col("turn")), F.col("w.degrees"), F.col("w.length")))
        sums = F.when(goes, F.struct(*[(F.col(f"sums.{k}") + v).alias(k) for k, v in added])).otherwise(F.col("sums")).alias("sums")
        both = checkpointed(on.select("path_id", "tile", row_of(F.col("to")).alias("row"), col_of(F.col("to")).alias("col"), more("path", F.col("to")), F.col("now_flat").alias("flat"), more("ways_taken", code), more("slopes", F.col("w.degrees")), sums, "stop"))
        ended, walk = both.filter("stop IS NOT NULL").select(*keys, "stop"), both.filter("stop IS NULL").drop("stop")
        parts.append(ended)
        if maximum_paths is not None:
            own = ended.groupBy("path_id").agg(F.count("*").alias("n"))
            ended_counts = checkpointed((own if ended_counts is None else ended_counts.union(own)).groupBy("path_id").agg(F.sum("n").alias("n")))
            many = ended_counts.union(walk.groupBy("path_id").agg(F.count("*").alias("n"))).groupBy("path_id").agg(F.sum("n").alias("n")).filter(F.col("n") >= maximum_paths).select("path_id")
            many = checkpointed(many)
            parts.append(checkpointed(walk.join(many, "path_id", "left_semi").select(*keys, F.lit("max_paths").alias("stop"))))
            walk = checkpointed(walk.join(many, "path_id", "left_anti"))
        if walk.isEmpty():
            break
    found = walk.select(*keys, F.lit("max_runout").alias("stop"))
    for part in parts:
        found = found.union(part)
    cells_of = F.transform("path", lambda c: F.struct(row_of(c).alias("row"), col_of(c).alias("col")))
    each = lambda of, name: F.transform("ways_taken", lambda c: of(c.cast("int"))).alias(name)
    long_way = F.array(*[F.lit(math.hypot(*d)) for d in D8])
    ways_taken = each(lambda c: c % 2 == 1, "validity"), each(lambda c: aside(F.shiftright(c, 1) % 8), "deviation"), F.col("slopes"), each(lambda c: F.get(long_way, F.shiftright(c, 4)), "lengths")
    return found.select("path_id", (F.size("path") - 1).alias("steps"), F.col("stop").alias("stop_reason"), cells_of.alias("cells"), *ways_taken, "sums")


def append_paths(stored: DataFrame, new: DataFrame) -> DataFrame:
    """IT-6: new paths beside the stored ones, best score first; those of equal path_id are replaced by the new ones."""
    return stored.join(new.select("path_id"), "path_id", "left_anti").unionByName(new, allowMissingColumns=True).orderBy(F.desc("score"), "path_id")
