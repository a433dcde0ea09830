"""Weight maps from grids and from points, as row-major arrays of height x width values.

Nulls and edges: an empty grid and a point list without a valid point give a map of ones; a cell or point whose weight is
missing, not numeric or NaN is left out; a grid that cannot be laid out (its cells are no square number, or a key with a
weight is no cell name) gives NULL, and ``dispatched`` says fallback.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegrid.functions.jsonclean import _point, as_map, points, weight
from placegrid.functions.numbers import clamp, kept_once

SIGMA = 0.2
#: Ratios up to this mean no attention at all.
LEAST_RATIO = 1e-6


def grid_side(cells: Column) -> Column:
    """n of a map<string,string> with n x n cells (1 for an empty one); NULL if it cannot be laid out."""
    n = F.bround(F.sqrt(F.size(cells).cast("double"))).cast("int")
    odd = F.exists(F.map_entries(cells), lambda e: (F.length(e["key"]) > 1) & weight(e["value"]).isNotNull() & ~F.substring(e["key"], 2, 99).rlike(r"^\s*[+-]?[0-9]+\s*$"))
    return F.when((n * n == F.size(cells)) & ~odd, F.greatest(n, F.lit(1)))


def named_cells(cells: Column) -> Column:
    """The map with upper-case letters (of two keys that become one the last counts)."""
    entries = F.map_entries(cells)
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(F.concat(F.upper(F.substring(e["key"], 1, 1)), F.substring(e["key"], 2, 99)).alias("key"), e["value"].alias("value"))))


def grid_weights(named: Column, n: Column) -> Column:
    """array<double> of n x n weights: missing or not numeric 1, others limited to [0, 2]. Both columns should be bound."""
    texts = F.transform(F.sequence(F.lit(0), n * n - 1), lambda i: F.try_element_at(named, F.concat(F.chr(F.floor(i / n) + 65), (i % n + 1).cast("string"))))
    return F.transform(F.transform(texts, weight), lambda w: F.coalesce(clamp(w, 0, 2), F.lit(1.0)))


def nearest(n: int, size: int) -> np.ndarray:
    """size x n: which cell each row belongs to; cell r fills [round(r size / n), round((r + 1) size / n)) (half to even), the last to the edge."""
    edge = np.round(np.arange(n) * size / n)
    return np.eye(n)[np.searchsorted(edge, np.arange(size), side="right") - 1]


def lerped(n: int, size: int) -> np.ndarray:
    """size x n: shares of the two cells around each row; half-pixel centres, source (i + .5) n / size - .5 not below 0."""
    source = np.maximum((np.arange(size) + 0.5) * (n / size) - 0.5, 0)
    low = np.minimum(np.floor(source).astype(int), n - 1)
    share = source - low
    return np.eye(n)[low] * (1 - share)[:, None] + np.eye(n)[np.minimum(low + 1, n - 1)] * share[:, None]


def laid(height: int, width: int, interpolate: bool) -> Callable[[Column, Column, Column], Column]:
    """Arrays of rows x columns values brought to height x width, in numpy batches; NULL stays NULL."""
    weights = lerped if interpolate else nearest

    @F.pandas_udf("array<double>")
    def run(values: pd.Series, rows: pd.Series, columns: pd.Series) -> pd.Series:
        out = np.empty(len(values), object)
        there = values.notna().to_numpy() & rows.notna().to_numpy()
        shapes = np.where(there, rows.fillna(0).to_numpy(np.int64) * (1 << 31) + columns.fillna(0).to_numpy(np.int64), -1)
        for shape in np.unique(shapes[there]):  # one product for all of a shape
            at, (r, c) = np.flatnonzero(shapes == shape), divmod(int(shape), 1 << 31)
            stack = np.stack(values.iloc[at].to_list()).astype(np.float64).reshape(-1, r, c)
            maps = weights(r, height) @ stack @ weights(c, width).T
            out[at] = list(maps.reshape(len(at), -1))
        return pd.Series(out)

    return run.asNondeterministic()  # so that filters on maps are not pushed below, which would lay them out twice


def grid_maps(rows: DataFrame, cells: str, height: int, width: int, interpolate: bool = False, name: str = "map") -> DataFrame:
    """Adds the map of each grid (a column of map<string,string>), NULL if it cannot be laid out."""
    sides = rows.withColumn("_n", grid_side(F.col(cells))).withColumn("_e", named_cells(F.col(cells)))
    weighted = sides.withColumn("_w", F.when(F.col("_n").isNotNull(), grid_weights(F.col("_e"), F.col("_n"))))
    return weighted.select(*rows.columns, laid(height, width, interpolate)("_w", "_n", "_n").alias(name))


def resized(values: Column, shape: tuple[int, int], height: int, width: int) -> Column:
    """A map of another shape brought to height x width bilinearly; one of the same shape stays."""
    return values if shape == (height, width) else laid(height, width, True)(values, F.lit(shape[0]), F.lit(shape[1]))


def valid_points(items: Column) -> Column:
    """array<struct<x,y,w>> of the points with two coordinates and a weight, limited to their ranges."""
    rows = F.filter(F.transform(items, _point), lambda q: F.coalesce((q["n"] == 2) & q["x"].isNotNull() & q["y"].isNotNull() & q["w"].isNotNull(), F.lit(False)))
    return F.transform(rows, lambda q: F.struct(clamp(q["x"], 0, 1).alias("x"), clamp(q["y"], 0, 1).alias("y"), clamp(q["w"], 0, 2).alias("w")))


def point_map(points: Column, height: int, width: int, sigma: float = SIGMA) -> Column:
    """Softmax over points (array<struct<x,y,w>>) of -d^2 / (2 sigma^2), weighted by w, in numpy; ones without points."""
    gy, gx = (g.ravel()[:, None] for g in np.meshgrid(np.linspace(0, 1, height), np.linspace(0, 1, width), indexing="ij"))

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series, ys: pd.Series, ws: pd.Series) -> pd.Series:
        out = np.empty(len(xs), object)
        sizes = np.array([-1 if x is None else len(x) for x in xs])
        for size in np.unique(sizes[sizes >= 0]):  # one softmax for all with as many points
            at = np.flatnonzero(sizes == size)
            if not size:
                out[at] = [np.ones(height * width)] * len(at)
                continue
            x, y, w = (np.stack(v.iloc[at].to_list()).astype(np.float64)[:, None, :] for v in (xs, ys, ws))
            logits = -((gx - x) ** 2 + (gy - y) ** 2) / (2 * sigma * sigma + 1e-12)
            e = np.exp(logits - logits.max(2, keepdims=True))
            out[at] = list(np.clip((e * w).sum(2) / e.sum(2), 0, 2))
        return pd.Series(out)

    return run.asNondeterministic()(points["x"], points["y"], points["w"])


def cells_of(maps: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """key, y, x, w of maps, row by row."""
    rows = maps.select(key, F.posexplode(column).alias("i", "w"))
    return rows.select(key, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), "w")


def annotated(queries: DataFrame, annotations: DataFrame) -> DataFrame:
    """Queries (basename) with the text of the annotation of the same stem; NULL where there is none.

    Of several annotations of a stem the one with the least file name counts, then the least text.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    known = annotations.groupBy(stem("filename").alias("_stem")).agg(F.min(F.struct("filename", "text")).alias("_first")).select("_stem", F.col("_first.text").alias("text"))
    return queries.withColumn("_stem", stem("basename")).join(known, "_stem", "left").drop("_stem")


def dispatched(rows: DataFrame, height: int, width: int, ratio: Column, text: str = "text", interpolate: bool = False, wrapped: bool = False) -> DataFrame:
    """Adds attention_status (plain, grid, points, fallback) and attention (a map, NULL where plain or fallback).

    A ratio up to LEAST_RATIO, no document, no result or one of another kind means plain; a wrapper's result is taken out.
    ``wrapped``: the documents are annotation files, whose weights are in ``result``; one without it is plain.
    """
    found = rows.withColumn("_d", F.when(ratio > LEAST_RATIO, F.try_parse_json(text)))
    inner = F.try_variant_get("_d", "$.result", "variant")
    found = found.withColumn("_d", inner if wrapped else F.when(inner.isNotNull(), inner).otherwise(F.col("_d"))).withColumn("_k", F.schema_of_variant("_d"))
    found = found.withColumn("_k", F.when(F.col("_k").startswith("OBJECT"), "object").when(F.col("_k").startswith("ARRAY"), "array")).withColumn("_t", F.to_json("_d"))
    found = found.withColumn("_m", F.when(F.col("_k") == "object", as_map(F.col("_t")))).withColumn("_n", grid_side(F.col("_m")))
    found = found.withColumn("_p", F.when(F.col("_k") == "array", valid_points(points(F.col("_t")))))
    found = grid_maps(found, "_m", height, width, interpolate, "_g").withColumn("_a", point_map(F.col("_p"), height, width))
    status = F.when(F.col("_k") == "array", "points").when((F.col("_k") == "object") & F.col("_n").isNotNull(), "grid").when(F.col("_k") == "object", "fallback").otherwise("plain")
    return kept_once(found.select(*rows.columns, status.alias("attention_status"), F.coalesce("_a", "_g").alias("attention")), "attention_status", "attention")
