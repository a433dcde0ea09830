"""Quality rules whose cutoffs are chosen under an exact bound on false rejection.

Each rule rejects a document whose signal lies above a cutoff. Labelled documents are the holdout; the strata are
languages. In each stratum a share of them (``DESIGN``, by a hash of doc_id) lays out one nested sequence of cutoffs of
all rules: rule by rule, in the order of what they gain, from the most lenient cutoff to the one that rejects most
labelled junk, less ``cost`` times the rejected good documents. The others test it (fixed-sequence testing needs no
correction along the way): a step is admissible while the exact binomial (Clopper-Pearson) upper bound on the false
rejection of good documents by all rules together stays at or below ``alpha``; the sum of the rules' counts stands for
their union, which it never falls below. The confidence is corrected by Bonferroni over the strata. Of the admissible
steps the one that rejects most labelled junk, less ``cost`` times the rejected good documents, is taken (ties: the
most lenient). So with probability ``1 - delta`` no stratum loses more than ``alpha`` of its good documents.

The ``STRATA`` languages with most labels are strata of their own, a null and an empty lang among them; further ones,
and those whose good labels are too few for a bound of their own, share a common stratum, whose bound holds for them
taken together. A stratum without cutoffs is reported as a warning.

Counts come from every document in one pass over the texts; what is collected is a histogram of at most
``(STRATA + 1) * rules * (BINS + 1)`` cells for each half of the labels.

Nulls and edges: a null text has no words and fails the base rule; a null lang is a language of its own; a null or
unlabelled doc_id is judged but does not calibrate; of several labels of a document the least quality counts; an empty
table gives no rows; further columns pass through ``kept_documents``, whatever their names.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegrid.llm.common import extended, mapped, texts, tune, written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_punct")
STRATA, BINS = 64, 200
#: The stratum of the languages that have none of their own.
COMMON = -1
#: One labelled document in so many lays out the sequence of cutoffs.
DESIGN = 4
#: Signal: (numerator, denominator); higher is worse.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "lines": ("n_dup_lines", "n_lines"),
    "upper": ("n_upper", "word_chars"),
    "punctuation": ("n_punct", "word_chars"),
}
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
PUNCT = b"!#$%&*+/<=>?@\\^_`{|}~"


def repeated(words: list[bytes], window: int = 8) -> int:
    """Words inside windows of 8 that occur twice or more in the text; exact, by doubling ranks 1, 2, 4, 8."""
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    span, count = 1, len(seen)
    while span < window:
        pair = rank[:-span] * count + rank[span:]
        found, rank = np.unique(pair, return_inverse=True)
        span, count = 2 * span, len(found)
        if count == len(rank):  # all differ, so all longer ones do
            return 0
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-window][again] += 1
    edge[window:][again] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measured(text: bytes) -> tuple[int, ...]:
    """The counts BASE and MORE of one text."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated(words),
        len(lines), len(joined) - len(joined.translate(None, UPPER)), len(joined) - len(joined.translate(None, PUNCT)),
    )


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every whole text."""

    def run(c: dict) -> dict:
        rows = [measured(t or b"") for t in c["text"]]
        return {"doc_id": c["doc_id"], "lang": c["lang"]} | {n: [r[i] for r in rows] for i, n in enumerate(BASE + MORE)}

    return mapped(texts(docs, "lang"), run, "doc_id long, lang string, " + ", ".join(f"{n} long" for n in BASE + MORE))


def stratum(langs: list[str | None]) -> Column:
    """The place of the document's language in ``langs``, or COMMON."""
    out = F.lit(COMMON)
    if None in langs:
        out = F.when(F.col("lang").isNull(), F.lit(langs.index(None))).otherwise(out)
    if own := [F.lit(x) for i, n in enumerate(langs) if n is not None for x in (n, i)]:
        out = F.coalesce(F.element_at(F.create_map(*own), F.col("lang")), out)
    return out


def level(rule: str) -> Column:
    """The signal in steps of 1 / BINS, from 0 to BINS."""
    over, under = RULES[rule]
    return F.floor(F.least(F.coalesce(F.try_divide(F.col(over), F.col(under)), F.lit(0.0)), F.lit(1.0)) * BINS).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def most_rejected(n: int, rate: float, risk: float) -> int:
    """The largest k for which the exact upper bound at confidence 1 - risk of k rejections in n is at most rate; -1: none."""
    top = int(n * rate) + 1
    k = np.arange(top + 1, dtype=np.float64)
    steps = np.log(np.maximum(n - k[:-1], 1e-300)) - np.log(k[1:]) + math.log(rate) - math.log1p(-rate)
    tail = np.exp(np.concatenate([[0.0], np.cumsum(steps)]) + n * math.log1p(-rate)).cumsum()
    return int((tail <= risk).sum()) - 1


def sequence(design: dict[str, np.ndarray], cost: float) -> list[tuple[str, int]]:
    """The steps (rule, cutoff), each a little stricter than the one before; ``design``: by rule [quality, level]."""
    value = {r: (above := h.sum(axis=1, keepdims=True) - np.cumsum(h, axis=1))[0] - cost * above[1] for r, h in design.items()}
    goal = {r: max(range(BINS + 1), key=lambda c: (v[c], c)) for r, v in value.items()}  # noqa: B023
    order = sorted((r for r in value if value[r][goal[r]] > 0), key=lambda r: (-value[r][goal[r]], r))
    return [(r, c) for r in order for c in range(BINS - 1, goal[r] - 1, -1)]


def cutoffs(hist: dict[tuple[int, str], np.ndarray], alpha: float, delta: float, cost: float, design: dict[tuple[int, str], np.ndarray] | None = None) -> dict[tuple[int, str], int]:
    """(stratum, rule) -> cutoff; hist: by stratum and rule an array [quality, level] of labelled documents.

    ``design`` is the same of documents that are not in ``hist``; without it the junk of ``hist`` alone, which the bound
    does not rest on, lays out the sequence.
    """
    strata, found = sorted({s for s, _ in hist}), {}
    for s in strata:
        own = {r: h for (t, r), h in hist.items() if t == s}
        plan = {r: (design or {}).get((s, r), np.zeros_like(h)) if design is not None else h * [[1], [0]] for r, h in own.items()}
        above = {r: h.sum(axis=1, keepdims=True) - np.cumsum(h, axis=1) for r, h in own.items()}  # rejected by cutoff c: level > c
        allowed = most_rejected(max(int(h[1].sum()) for h in own.values()), alpha, delta / len(strata))
        at, best, taken = dict.fromkeys(own, BINS), 0.0, {}
        for rule, c in sequence(plan, cost):
            at[rule] = c
            junk, good = (sum(int(above[r][q][at[r]]) for r in at) for q in (0, 1))
            if good > allowed:
                break  # nested: the first failure ends the sequence
            if junk - cost * good > best:
                best, taken = junk - cost * good, {(s, r): c for r, c in at.items() if c < BINS}
        found |= taken
    return found


def pooled(good: dict[int, int], alpha: float, delta: float) -> set[int]:
    """The strata whose good labels are too few for a bound of their own: they join COMMON."""
    return {s for s, n in good.items() if s == COMMON or most_rejected(n, alpha, delta / max(len(good), 1)) < 0}


def calibrated(stats: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, cost: float = 20.0) -> tuple[dict[tuple[int, str], int], list[str | None]]:
    """Cutoffs from the labelled documents among ``stats``, and the languages that are strata of their own."""
    least = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = written(stats.where(~base_failed()).join(least, "doc_id"))
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(STRATA).collect()]
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES]))
    plans = (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(DESIGN)) == 0).alias("plans")
    rows = (
        known.select(stratum(langs).alias("stratum"), plans, (F.col("quality") > 0).cast("int").alias("good"), cells.alias("cell"))
        .groupBy("stratum", "plans", "good", "cell.rule", "cell.level").count().collect()
    )
    good = dict.fromkeys({r["stratum"] for r in rows}, 0)
    for r in rows:
        good[r["stratum"]] += r["count"] if r["good"] and not r["plans"] and r["rule"] == next(iter(RULES)) else 0
    small = pooled(good, alpha, delta)
    langs = [n for i, n in enumerate(langs) if i not in small]
    place = dict(zip(sorted(set(good) - small), range(len(langs)), strict=True))
    hist: dict[bool, dict[tuple[int, str], np.ndarray]] = {False: {}, True: {}}
    for r in rows:
        key = place.get(r["stratum"], COMMON), r["rule"]
        for half in hist.values():
            half.setdefault(key, np.zeros((2, BINS + 1), np.int64))
        hist[r["plans"]][key][r["good"], r["level"]] += r["count"]
    cuts = cutoffs(hist[False], alpha, delta, cost, hist[True])
    for s in sorted({s for s, _ in hist[False]} - {s for s, _ in cuts}):
        logging.getLogger(__name__).warning("no cutoffs for %s", "the common stratum" if s == COMMON else f"lang {langs[s]!r}")
    return cuts, langs


def rejected(cuts: dict[tuple[int, str], int], langs: list[str | None]) -> Column:
    """Whether a rule of the document's stratum rejects it."""
    out = F.lit(False)
    for rule in RULES:
        if own := [x for (s, r), c in cuts.items() if r == rule for x in (F.lit(s), F.lit(c))]:
            out = out | (level(rule) > F.coalesce(F.element_at(F.create_map(*own), stratum(langs)), F.lit(BINS)))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """doc_id, counts, base_failed and kept of every document."""
    tune(docs.sparkSession)
    stats = written(signals(docs))
    cuts, langs = calibrated(stats, labels, alpha, delta)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | rejected(cuts, langs)))


def kept_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """The documents that no rule rejects, with their own columns; the texts are measured again rather than shuffled."""
    tune(docs.sparkSession)
    cuts, langs = calibrated(written(signals(docs)), labels, alpha, delta)

    def run(texts: list) -> dict:
        rows = [measured(t or b"") for t in texts]
        return {n: [r[i] for r in rows] for i, n in enumerate(BASE + MORE)}

    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called, none clashes
    rows = extended(docs.toDF(*names), run, ", ".join(f"{n} long" for n in BASE + MORE), names[docs.columns.index("text")])
    rows = rows.withColumn("lang", F.col(names[docs.columns.index("lang")]))
    return rows.where(~(base_failed() | rejected(cuts, langs))).select(*names).toDF(*docs.columns)
