"""Cleaning, verifying and patching what a vision-language model returns as JSON.

Texts are parsed leniently at the edge into map<string,string> or array<string>, then cast cell by cell, so one bad
cell never spoils a document. A grid is {"A1": weight, ...} over grid x grid cells; a point list has objects with
center [x, y], weight and reasoning. Weights lie in [0, 2], coordinates in [0, 1].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegrid.functions.numbers import NUMBER, clamp, fenced, kept_once

#: A reason keeps its JSON type, as a number is no reason.
POINT = "center string, weight string, reasoning variant"


def clean_initial(text: Column) -> Column:
    """The JSON part of a reply: fences and trailing commas dropped, then the outermost list or object, whichever
    starts first; "none" in any case becomes the token None."""
    t = _unfenced(text)
    return _outermost(t, *_found(t))


def _unfenced(text: Column) -> Column:
    t = F.regexp_replace(text, "(?i)```json|```", "")
    return F.regexp_replace(F.regexp_replace(t, r",\s*([}\]])", "$1"), r"^\s+|\s+$", "")


def _found(t: Column) -> tuple[Column, Column]:
    """The outermost list and the outermost object; empty: none."""
    return F.regexp_extract(t, r"(?s)(\[.*\])", 1), F.regexp_extract(t, r"(?s)(\{.*\})", 1)


def _outermost(t: Column, found_list: Column, found_map: Column) -> Column:
    list_first = (found_list != "") & ((found_map == "") | (F.instr(t, "[") < F.instr(t, "{")))
    body = F.when(list_first, found_list).when(found_map != "", found_map).otherwise(t)
    return F.when(F.lower(t) == "none", F.lit("None")).otherwise(F.trim(body))


def kind(text: Column) -> Column:
    """object, array, other, or NULL if the text is not JSON."""
    return _kind(F.schema_of_variant(F.try_parse_json(text)))


def _kind(v: Column) -> Column:
    return F.when(v.startswith("OBJECT"), "object").when(v.startswith("ARRAY"), "array").when(v.isNotNull(), "other")


def weight(text: Column) -> Column:
    """A cell as a number; JSON true and false count as 1 and 0."""
    t = F.when(text == "true", "1").when(text == "false", "0").otherwise(F.trim(text))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def grid_keys(grid: int = 4) -> list[str]:
    return [f"{chr(65 + r)}{c + 1}" for r in range(grid) for c in range(grid)]


def as_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def numbers(cells: Column, grid: int) -> Column:
    """The grid's cells as array<double>, each looked up and parsed once; NULL where missing or not numeric."""
    return F.transform(F.array(*[F.try_element_at(cells, F.lit(k)) for k in grid_keys(grid)]), weight)


def verify_grid(cells: Column, grid: int = 4) -> Column:
    """All cells present, numeric and within [0, 2]; further keys are allowed."""
    return in_range(numbers(cells, grid))


def in_range(weights: Column) -> Column:
    return F.forall(weights, lambda w: F.coalesce(w.between(0, 2), F.lit(False)))


def patch_grid(cells: Column, grid: int = 4) -> Column:
    """map<string,string>: the grid's cells, missing or not numeric 1.0, others limited to [0, 2]; further keys as they are.

    ``cells`` should be a column of its own: an expression would be parsed again for each use.
    """
    return patched_cells(cells, numbers(cells, grid), grid)


def patched_cells(cells: Column, weights: Column, grid: int) -> Column:
    """The same from cells whose ``numbers`` are known."""
    keys = F.array(*[F.lit(k) for k in grid_keys(grid)])
    values = F.transform(weights, lambda w: F.coalesce(clamp(w, 0, 2), F.lit(1.0)).cast("string"))
    more = F.map_filter(F.coalesce(cells, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(keys, k))
    return F.map_concat(F.map_from_arrays(keys, values), more)


def points(text: Column) -> Column:
    """array<struct<center,weight,reasoning>> of texts; an item that is no object is NULL."""
    return F.transform(F.from_json(text, "array<string>"), lambda item: F.when(item.startswith("{"), F.from_json(item, POINT)))


def _point(p: Column) -> Column:
    place = lambda xy: F.struct(F.size(xy).alias("n"), weight(F.get(xy, F.lit(0))).alias("x"), weight(F.get(xy, F.lit(1))).alias("y"))
    at = F.transform(F.array(F.from_json(p["center"], "array<string>")), place)  # of one item, so that the center is parsed once
    reasoning = F.when(F.schema_of_variant(p["reasoning"]) == "STRING", F.trim(F.try_variant_get(p["reasoning"], "$", "string")))
    whole = F.transform(at, lambda c: F.struct(c["n"].alias("n"), c["x"].alias("x"), c["y"].alias("y"), weight(p["weight"]).alias("w"), reasoning.alias("reasoning")))
    return F.get(whole, F.lit(0))


def verify_points(items: Column) -> Column:
    """Not empty, and every item has a center of two numbers in [0, 1], a weight in [0, 2] and a reason that is a text."""
    return all_valid(valid_rows(items))


def valid_rows(items: Column) -> Column:
    """The items with their numbers, each parsed once."""
    return F.transform(items, _point)


def all_valid(rows: Column) -> Column:
    good = lambda q: F.coalesce((q["n"] == 2) & q["x"].between(0, 1) & q["y"].between(0, 1) & q["w"].between(0, 2) & (q["reasoning"] != ""), F.lit(False))
    return F.coalesce((F.size(rows) > 0) & F.forall(rows, good), F.lit(False))


def patch_points(items: Column) -> Column:
    """Valid items only, limited to their ranges, reasons trimmed."""
    return fitting(valid_rows(items))


def fitting(rows: Column) -> Column:
    fit = F.filter(rows, lambda q: F.coalesce((q["n"] == 2) & q["x"].isNotNull() & q["y"].isNotNull() & q["w"].isNotNull() & (q["reasoning"] != ""), F.lit(False)))
    return F.transform(fit, lambda q: F.struct(F.array(clamp(q["x"], 0, 1), clamp(q["y"], 0, 1)).alias("center"), clamp(q["w"], 0, 2).alias("weight"), q["reasoning"].alias("reasoning")))


def processed(text: Column, form: str, grid: int = 4) -> Column:
    """struct(result, format_verified, content_verified, no_weighting) of a raw reply; form: grid or points."""
    clean = clean_initial(text)
    if form == "grid":
        return _flags(clean, kind(clean) == "object", verify_grid(as_map(clean), grid))
    return _flags(clean, kind(clean) == "array", verify_points(points(clean)))


def process(rows: DataFrame, text: str, form: str, name: str, grid: int = 4) -> DataFrame:
    """``rows`` with ``name``, what ``processed`` makes of a column. Each step's value is made once, where a single
    expression would clean and parse the text again for each use."""
    steps = ["_t", "_list", "_map", "_clean", "_kind", "_parsed", "_good"]
    c = {n: F.col(n) for n in steps}
    rows = kept_once(rows.withColumn("_t", _unfenced(F.col(text))), "_t")
    found_list, found_map = _found(c["_t"])
    rows = kept_once(rows.withColumn("_list", found_list).withColumn("_map", found_map), "_list", "_map")
    rows = kept_once(rows.withColumn("_clean", _outermost(c["_t"], c["_list"], c["_map"])), "_clean")
    rows = kept_once(rows.withColumn("_kind", F.schema_of_variant(F.try_parse_json("_clean"))), "_kind")
    right = _kind(c["_kind"]) == ("object" if form == "grid" else "array")
    parsed = as_map(c["_clean"]) if form == "grid" else points(c["_clean"])
    rows = kept_once(rows.withColumn("_parsed", F.when(right, parsed)), "_parsed")
    rows = kept_once(rows.withColumn("_good", F.when(right, numbers(c["_parsed"], grid) if form == "grid" else valid_rows(c["_parsed"]))), "_good")
    content = in_range(c["_good"]) if form == "grid" else all_valid(c["_good"])
    return kept_once(rows.withColumn(name, _flags(c["_clean"], right, content)), name).drop(*steps)


def _flags(clean: Column, right: Column, content: Column) -> Column:
    none, right = F.lower(clean) == "none", F.coalesce(right, F.lit(False))
    return F.struct(
        F.when(~none, clean).alias("result"), (none | right).alias("format_verified"), (none | (right & content)).alias("content_verified"), none.alias("no_weighting"),
    )


def failed(format_verified: Column, content_verified: Column) -> Column:
    """Whether a document counts as failed: a missing flag is false."""
    return ~(F.coalesce(format_verified, F.lit(False)) & F.coalesce(content_verified, F.lit(False)))


def verify_matches(text: Column, strict_key: bool = False) -> Column:
    """A rerank answer: matches is null or a list whose items have image_number and confidence.

    ``strict_key`` also asks for a key top_100, as an older verifier did.
    """
    doc = as_map(text)
    items = F.from_json(F.try_element_at(doc, F.lit("matches")), "array<map<string,string>>")
    whole = F.forall(items, lambda m: F.map_contains_key(m, "image_number") & F.map_contains_key(m, "confidence"))
    good = F.map_contains_key(doc, "matches") & F.coalesce(F.try_element_at(doc, F.lit("matches")).isNull() | whole, F.lit(False))
    if strict_key:
        good = good & F.map_contains_key(doc, "top_100")
    return F.coalesce(good, F.lit(False))


def saved_response(response: Column, grid: int = 4) -> Column:
    """struct(result, format_verified, content_verified, no_weighting) as an annotation keeps it: the verified JSON, else
    the whole response; NULL without weighting. ``grid`` 0 asks for a point list, more for a grid, less is an error."""
    if grid < 0:
        raise ValueError(f"invalid grid {grid}")
    d = processed(response, "grid" if grid else "points", grid or 4)
    kept = F.when(d["no_weighting"], F.lit(None)).when(d["format_verified"] & d["content_verified"], d["result"]).otherwise(response)
    return F.struct(kept.alias("result"), d["format_verified"].alias("format_verified"), d["content_verified"].alias("content_verified"), d["no_weighting"].alias("no_weighting"))


def repaired(documents: DataFrame, text: str = "text", grid: int = 4) -> DataFrame:
    """Annotation documents (wrappers with ``result``) verified and, where they fail, patched and verified again.

    Adds result (JSON text), format_verified, content_verified (NULL: the document is left as it was) and no_weighting.
    A string result is cleaned and parsed first. Whatever is no JSON, has no result or one of another kind has no format.
    """
    v = F.try_parse_json(text)
    rows = documents.withColumn("_v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))
    rows = rows.withColumn("_r", F.try_variant_get("_v", "$.result", "variant")).withColumn("_k", F.schema_of_variant("_r"))
    plain = F.coalesce(F.try_variant_get("_v", "$.no_weighting", "boolean"), F.lit(False)) & F.coalesce(F.col("_k") == "VOID", F.lit(True))
    whole = F.when(F.col("_k") == "STRING", clean_initial(F.try_variant_get("_r", "$", "string"))).when(F.col("_k").startswith("OBJECT") | F.col("_k").startswith("ARRAY"), F.to_json("_r"))
    rows = rows.withColumn("no_weighting", F.col("_v").isNotNull() & plain).withColumn("_t", whole).withColumn("_kind", kind(F.col("_t")))
    rows = rows.withColumn("_cells", F.when(F.col("_kind") == "object", as_map(F.col("_t")))).withColumn("_points", F.when(F.col("_kind") == "array", points(F.col("_t"))))
    # A patched grid is valid as it is made, and so are patched points unless none is left.
    weights, good = numbers(F.col("_cells"), grid), valid_rows(F.col("_points"))
    rows = rows.withColumn("_w", F.when(F.col("_kind") == "object", weights)).withColumn("_q", F.when(F.col("_kind") == "array", good))
    right = F.when(F.col("_kind") == "object", in_range(F.col("_w"))).when(F.col("_kind") == "array", all_valid(F.col("_q")))
    rows = rows.withColumn("_ok", right).withColumn("_p", F.when(~F.col("_ok") & (F.col("_kind") == "array"), fitting(F.col("_q"))))
    patched = F.when(F.col("_kind") == "object", F.to_json(patched_cells(F.col("_cells"), F.col("_w"), grid))).otherwise(F.to_json(F.col("_p")))
    known = F.col("no_weighting") | F.col("_kind").isin("object", "array")
    result = F.when(F.col("_kind").isin("object", "array"), F.when(F.col("_ok"), F.col("_t")).otherwise(patched))
    content = F.when(known, F.col("no_weighting") | F.col("_ok") | F.when(F.col("_kind") == "array", F.size("_p") > 0).otherwise(F.lit(True)))
    out = rows.select(*documents.columns, result.alias("result"), F.when(known, F.lit(True)).alias("format_verified"), content.alias("content_verified"), "no_weighting")
    return fenced(out)  # a filter on the flags would otherwise copy the whole chain


def top100(response: Column) -> Column:
    """struct(cleaned, format_verified, content_verified, original): the original response is kept only if it is no JSON."""
    clean = clean_initial(response)
    found = kind(clean)
    return F.struct(
        F.when(found.isNotNull(), clean).alias("cleaned"), F.coalesce(found == "object", F.lit(False)).alias("format_verified"), verify_matches(clean).alias("content_verified"),
        F.when(found.isNull(), response).alias("original"),
    )
