"""Cutoffs of the quality rules: enough labels for a verdict, one bound for all rules together."""

from __future__ import annotations

import numpy as np

from placegrid.llm import quality_rules
from placegrid.llm.quality_rules import BINS, RULES

LABELS = "doc_id long, quality int, toxic int"


def table(spark, kinds):
    """Documents and labels from (lang, number, symbols at the end of the text, quality)."""
    words = ["".join(w) for w in np.random.default_rng(1).choice(list("aeiounrst"), (900, 6))]
    rows, labels = [], []
    for lang, n, symbols, quality in kinds:
        for _ in range(n):
            i = len(rows)
            rows.append((i, " ".join(words[(i * 7 + 11 * j) % 900] for j in range(25)) + " " + "#" * symbols, lang))
            labels.append((i, quality, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)


def test_few_hundred_labels_reject_junk(spark):
    kinds = [(lang, n, s, int(not s)) for lang, good in (("en", 700), ("de", 450), (None, 450), ("fr", 100)) for n, s in ((good, 0), (60, 40))]
    docs, labels = table(spark, kinds)
    out = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").toPandas()
    assert not out["base_failed"].any()
    assert (out["kept"] == (out["quality"] == 1)).all()


def test_the_bound_holds_for_all_rules_together():
    rng = np.random.default_rng(8)
    lost, rules = [], list(RULES)
    for _ in range(200):  # every rule rejects its own 0.4 % of good documents: two stay below 1 %, five do not
        bad = rng.multinomial(3000, [0.004] * 5 + [0.98])[:5]
        hist = {(0, r): np.zeros((2, BINS + 1), np.int64) for r in rules}
        for r, b in zip(rules, bad, strict=True):
            hist[0, r][0, 100], hist[0, r][1, 100], hist[0, r][1, 0] = 900, b, 3000 - b
        lost.append(0.004 * len(quality_rules.cutoffs(hist, 0.01, 0.05, 20.0)))
    assert np.mean(np.array(lost) > 0.01) <= 0.05 and max(lost) > 0


def test_small_strata_are_pooled():
    assert quality_rules.pooled({0: 1500, 1: 366, 2: 366, 3: 233}, 0.01, 0.05) == {1, 2, 3}
    assert quality_rules.pooled({0: 440}, 0.01, 0.05) == set()
