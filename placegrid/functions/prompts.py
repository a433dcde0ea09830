"""Prompts and messages: templates, search, image markers, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_TOKENS = 1500


def filled(template: Column, values: dict[str, Column]) -> Column:
    """Literal replacement of {key}; a missing prompt raises."""
    out = F.when(template.isNull(), F.raise_error("no such prompt")).otherwise(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value.cast("string"))
    return F.trim(out)


def search(prompts: DataFrame, keyword: str) -> DataFrame:
    """(category, name, text) whose text or name holds the keyword in any case."""
    k = F.lit(keyword.lower())
    return prompts.where(F.contains(F.lower("text"), k) | F.contains(F.lower("name"), k)).select("category", "name", "text")


def expand_markers(text: Column) -> Column:
    """{IMAGE_a-b} becomes {IMAGE_a} ... {IMAGE_b}, space separated; other text stays."""
    pattern = r"\{IMAGE_([0-9]+)-([0-9]+)\}"
    between = F.split(text, pattern)
    low, high = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    spans = F.zip_with(low, high, lambda a, b: F.array_join(F.transform(F.when(a.cast("int") <= b.cast("int"), F.sequence(a.cast("int"), b.cast("int"))).otherwise(F.array()), lambda i: F.concat(F.lit("{IMAGE_"), i.cast("string"), F.lit("}"))), " "))
    return F.array_join(F.zip_with(between, spans, lambda t, s: F.concat(t, F.coalesce(s, F.lit("")))), "")


def message_parts(text: Column, images: Column) -> Column:
    """array<struct<kind,value>>: text and {IMAGE_n} parts in order; blank texts and images out of range are dropped."""
    pattern = r"\{IMAGE_([0-9]+)\}"
    texts = F.transform(F.split(text, pattern), lambda t: F.struct(F.lit("text").alias("kind"), F.trim(t).alias("value")))
    marks = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit("image").alias("kind"), n.alias("value")))
    parts = F.flatten(F.zip_with(texts, marks, lambda t, m: F.array(t, m)))
    fits = lambda p: F.when(p["kind"] == "image", p["value"].cast("int") < images).otherwise(p["value"] != "")
    return F.filter(parts, lambda p: F.coalesce(fits(p), F.lit(False)))


def token_estimate(text: Column, images: Column) -> Column:
    """White-space words plus a fixed number for each image."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) + IMAGE_TOKENS * images


def categories(prompts: DataFrame) -> DataFrame:
    return prompts.select("category").distinct()


def listed(prompts: DataFrame, category: str) -> DataFrame:
    """name, text of a category's prompts; a category that is not there is an error."""
    found = prompts.where(F.col("category") == category).select("name", "text")
    if found.isEmpty():
        raise ValueError(f"no such category: {category}")
    return found


def added(prompts: DataFrame, more: DataFrame) -> DataFrame:
    """``prompts`` with those of ``more`` (trimmed) put in or replaced; (category, name) is the key of both."""
    kept = prompts.join(more.select("category", "name"), ["category", "name"], "left_anti").select("category", "name", "text")
    return kept.unionByName(more.select("category", "name", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")))


def converted(messages: Column) -> Column:
    """Messages (array<struct<role, content: array<struct<type, text, url>>>>) as array<struct<role, parts>>.

    System messages are dropped, assistant becomes model; an image's data URL becomes inline data (what follows the
    first comma up to the next), another URL a file. A part is struct<kind, value> of kind text, inline_data or file_data.
    """

    def part(c: Column) -> Column:
        data = c["url"].startswith("data:")
        kind = F.when(c["type"] == "text", "text").when(data, "inline_data").otherwise("file_data")
        return F.struct(kind.alias("kind"), F.when(c["type"] == "text", c["text"]).when(data, F.get(F.split(c["url"], ","), F.lit(1))).otherwise(c["url"]).alias("value"))

    kept = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    fits = lambda c: c["type"].isin("text", "image_url")
    return F.transform(kept, lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise(m["role"]).alias("role"), F.transform(F.filter(m["content"], fits), part).alias("parts")))
