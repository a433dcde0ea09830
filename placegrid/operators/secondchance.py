"""A second chance for replies that are no JSON: a model is asked to mend them.

Replies are cleaned first. The distinct texts that still do not parse go to a plug-in (a chat model: messages to reply), each
once however many rows have it; what it returns is cleaned and parsed once, as a whole reply, and joined to the rows. A
text that the model cannot mend, or fails on, stays as it was, with the error in its rows alone.

Nulls and edges: a NULL reply is not asked about and has no format; "none" in any case is an answer of its own where
weights are asked for, and a broken text where candidates are; ties, repeated rows and rows that share a broken text get the same reply; extra columns pass through, unless they are
called like those that are added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegrid.functions.jsonclean import as_map, clean_initial, kind, points, verify_grid, verify_matches, verify_points
from placegrid.functions.numbers import kept_once
from placegrid.scratch import written
from placegrid.sources.agents import Chat, retried, user, worker

#: How a model is asked; the text follows on the next line.
PROMPT = "Please fix the following JSON so it is valid and follows the expected structure."


def asked(texts: DataFrame, name: str, load: Callable[[], Chat], prompt: str = PROMPT, tries: int = 1) -> DataFrame:
    """broken, reply, error of the distinct texts of a column ``broken``; rests on a written table, so each is asked once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = worker(name, load)
        for b in batches:
            rows = []
            for text in b["broken"]:
                try:
                    rows.append((text, retried(lambda: chat([user(f"{prompt}\n{text}", [])]), tries), None))  # noqa: B023
                except Exception as e:  # noqa: BLE001  user code: recorded, never fatal
                    rows.append((text, None, repr(e)))
            yield pd.DataFrame(rows, columns=["broken", "reply", "error"])

    return written(texts.select("broken").distinct().mapInPandas(run, "broken string, reply string, error string"))


def mended(rows: DataFrame, text: str, name: str, load: Callable[[], Chat], prompt: str = PROMPT, tries: int = 1, none_counts: bool = True) -> DataFrame:
    """Adds cleaned (JSON, or the token None; NULL: not to be had), mended (whether by the model), model_error.

    ``none_counts``: "none" is an answer; otherwise it is a broken text like others.
    """
    clean = kept_once(rows.withColumn("_c", clean_initial(F.col(text))), text, "_c")
    none = (F.lower("_c") == "none") & F.lit(none_counts)
    tagged = clean.withColumn("_b", F.when(~none & kind(F.col("_c")).isNull(), F.col("_c")))
    replies = asked(tagged.where("_b is not null").select(F.col("_b").alias("broken")), name, load, prompt, tries)
    fixed = replies.select(F.col("broken").alias("_b"), clean_initial(F.col("reply")).alias("_r"), F.col("error").alias("model_error"))
    fixed = fixed.withColumn("_r", F.when(kind(F.col("_r")).isNotNull(), F.col("_r")))
    both = tagged.join(fixed, "_b", "left")
    cleaned = F.when(F.col("_b").isNull(), F.col("_c")).otherwise(F.col("_r"))
    return both.select(*rows.columns, cleaned.alias("cleaned"), (F.col("_b").isNotNull() & F.col("_r").isNotNull()).alias("mended"), "model_error")


def flags(cleaned: Column, form: str, grid: int = 4) -> tuple[Column, Column]:
    """(format, content) verified of a cleaned reply; form: grid, points or matches."""
    found = kind(cleaned)
    if form == "grid":
        right, content = found == "object", verify_grid(as_map(cleaned), grid)
    elif form == "points":
        right, content = found == "array", verify_points(points(cleaned))
    else:
        right, content = found == "object", verify_matches(cleaned)
    none = F.lower(cleaned) == "none"
    return F.coalesce(none | right, F.lit(False)), F.coalesce(none | (right & content), F.lit(False))


def top100_mended(rows: DataFrame, text: str, name: str, load: Callable[[], Chat], tries: int = 1) -> DataFrame:
    """Rerank answers with a second chance: adds cleaned, format_verified, content_verified, original, mended, model_error.

    ``original`` is the answer as it came, kept only if it could not be had as JSON by either way.
    """
    out = mended(rows, text, name, load, tries=tries, none_counts=False)
    right, content = flags(F.col("cleaned"), "matches")
    return out.select(*rows.columns, "cleaned", right.alias("format_verified"), content.alias("content_verified"), F.when(F.col("cleaned").isNull(), F.col(text)).alias("original"), "mended", "model_error")


def repaired_by_model(documents: DataFrame, text: str, name: str, load: Callable[[], Chat], form: str = "points", grid: int = 4, tries: int = 1) -> DataFrame:
    """Raw replies as ``jsonclean.processed`` has them, with a second chance: adds result, format_verified, content_verified,
    no_weighting, mended, model_error."""
    out = mended(documents, text, name, load, tries=tries)
    right, content = flags(F.col("cleaned"), form, grid)
    none = F.lower("cleaned") == "none"
    return out.select(*documents.columns, F.when(~none, F.col("cleaned")).alias("result"), right.alias("format_verified"), content.alias("content_verified"), F.coalesce(none, F.lit(False)).alias("no_weighting"), "mended", "model_error")


def mending_model() -> Chat:
    """A deterministic model for tests and queries: it reads the broken text in the prompt and balances what is open.

    Single quotes become double ones, text outside the outermost bracket goes, a comma at the end goes, and brackets
    that are open at the end are closed. A text without any bracket is beyond it: it fails.
    """

    def chat(messages: list[dict]) -> str:
        text = messages[-1]["content"][-1]["text"].partition("\n")[2].replace("'", '"')
        starts = [i for i in (text.find("["), text.find("{")) if i >= 0]
        if not starts:
            raise ValueError("no JSON to be seen")
        text = text[min(starts) :].rstrip().rstrip(",")
        open_, quoted = [], False
        for c in text:
            if c == '"':
                quoted = not quoted
            elif not quoted and c in "[{":
                open_.append("]" if c == "[" else "}")
            elif not quoted and c in "]}" and open_:
                open_.pop()
        return "```json\n" + text + ('"' if quoted else "") + "".join(reversed(open_)) + "\n```"

    return chat
