"""The language model against scalar versions: gradients, states across windows, sums of probabilities, counts."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from placegrid.llm import queries, recurrent
from placegrid.llm.recurrent import END, Network, Vocabulary


def small(words: int = 12, endings: int = 3, seed: int = 3) -> Vocabulary:
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(1, 90, words))[::-1].astype(np.float64)
    sums, kinds = rng.integers(5, 30, endings).astype(np.float64), np.full(endings, 4.0)
    return Vocabulary([END, *(b"w%d" % i for i in range(1, words))], counts, np.array([0, 1, 4, 7, words]), {b"aa": 0, b"bb": 1}, sums, kinds, int(counts.sum() + sums.sum()), words + 4 * endings)


def network(seed: int = 1) -> Network:
    n = Network(small(), hidden=5, seed=seed)
    rng = np.random.default_rng(9)
    for table in (n.gates, n.out):
        for k, p in table.items():
            table[k] = p.astype(np.float64) + rng.normal(0, 0.3, p.shape)
    return n


def one_by_one(n: Network, docs: list[list[int]]) -> list[float]:
    """Scores token by token, with a softmax written out."""
    k, out = n.hidden, []
    for d in docs:
        h, before, total = np.zeros(k), 0, 0.0
        for t in [*d, 0]:
            x, u = n.gates["input"][before] + n.gates["shift"], h @ n.gates["state"]
            z, r = (1 / (1 + np.exp(-(x[i : i + k] + u[i : i + k]))) for i in (0, k))
            h = (1 - z) * np.tanh(x[2 * k :] + r * u[2 * k :]) + z * h
            a = np.exp(n.out["class"] @ h + n.out["class_bias"])
            c = n.of[t]
            total += math.log(a[c] / a.sum())
            if c < len(n.start) - 1:
                own = np.arange(n.start[c], n.start[c + 1])
                e = np.exp(n.out["word"][own] @ h + n.out["word_bias"][own])
                total += math.log(e[t - own[0]] / e.sum())
            before = t
        out.append(total)
    return out


@pytest.mark.parametrize("window", [1, 3, 24])
def test_states_carry_across_windows(window: int) -> None:
    n, r = network(), random.Random(1)
    docs = [[r.randrange(15) for _ in range(r.choice([0, 1, 2, 7, 23, 24, 25, 60]))] for _ in range(30)]
    got = n.scored([np.array(d, np.int64) for d in docs], window)
    assert np.allclose(got, one_by_one(n, docs), rtol=1e-9, atol=1e-5)  # states are kept as 32-bit numbers
    assert n.scored([]).tolist() == []


def test_probabilities_sum_to_one() -> None:
    n = network()
    h = np.random.default_rng(2).normal(0, 1, (1, 5))
    assert math.isclose(sum(math.exp(n.log_likelihood(h, np.array([t]))[0]) for t in range(15)), 1, rel_tol=1e-9)


def test_gradients(monkeypatch) -> None:
    n, rng = network(), np.random.default_rng(4)
    token = rng.integers(0, 15, (6, 3))
    fresh = rng.random((6, 3)) < 0.3
    fresh[0] = True
    before = np.where(fresh, 0, np.vstack([np.zeros((1, 3), int), token[:-1]]))

    def loss() -> float:
        h, states = np.zeros((3, 5)), []
        for t in range(6):
            h = n.step(n.gates["input"][before[t]] + n.gates["shift"], np.where(fresh[t][:, None], 0, h))[0]
            states.append(h)
        return -n.log_likelihood(np.concatenate(states), token.ravel()).sum() / 3

    grads: dict[str, np.ndarray] = {}

    def moved(name: str, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        whole = grads.setdefault(name, np.zeros_like((n.gates if name in n.gates else n.out)[name]))
        whole[slice(None) if rows is None else rows] += g

    monkeypatch.setattr(n, "moved", moved)
    monkeypatch.setattr(recurrent, "limited", lambda g: g)
    n.learn(before, token, fresh, np.zeros((3, 5)))
    for name, g in grads.items():
        p = (n.gates if name in n.gates else n.out)[name]
        for at in random.Random(name).sample(list(np.ndindex(p.shape)), min(p.size, 25)):
            kept, e = p[at], 1e-5
            p[at] = kept + e
            high = loss()
            p[at] = kept - e
            numeric, p[at] = (high - loss()) / (2 * e), kept
            assert math.isclose(numeric, g[at], rel_tol=1e-2, abs_tol=2e-3), (name, at, numeric, g[at])


SCHEMA = "text string, doc_id long, score int, word string"


def grammar(r: random.Random, size: int) -> str:
    """Words of two tongues that never mix, each followed by one of few."""
    tongue, at, out = r.choice("xy"), 0, []
    for _ in range(size):
        at = (3 * at + r.randrange(3)) % 40
        out.append(f"{tongue}{at}" if r.random() < 0.9 else f"{tongue}rare{r.randrange(2000)}")
    return " ".join(out)


def test_query_against_counts_and_base(spark, tmp_path) -> None:
    r = random.Random(8)
    texts = [None, "", " \n ", "Unseen words only here", *(grammar(r, r.randint(1, 120)).title() for _ in range(500)), *["Same text twice"] * 2]
    spark.createDataFrame([(i, t, "en", "web", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op13_recurrent_language_model(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    tokens = [[*(t or "").encode().lower().split(), END] for t in texts]
    out = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = Counter(w for t, o in zip(tokens, out, strict=True) if not o for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (out[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [i for i in got if out[i] and got[i].n_tokens > 5]
    size = sum(got[i].n_tokens for i in held)
    gain = sum(got[i].score - got[i].base_score for i in held) / size
    assert gain > 0.4, gain  # two tongues, and three in forty words that may follow


def test_edges(spark) -> None:
    rows = [(None, None, 1, "w"), ("a b a", None, 1, "w"), ("a b a", None, 1, "w"), ("a", 7, None, None)]
    got = recurrent.log_likelihoods(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.doc_id or 0, x.held_out, x.n_tokens, x.n_known, x.train_tokens) for x in got)[0][0] == 0 and len(got) == 4
    assert {x.train_tokens for x in got} == {0 if recurrent.held_out(7) else 2}
    assert all(math.isfinite(x.score) for x in got)
    none = recurrent.log_likelihoods(spark.createDataFrame(rows[:3], SCHEMA)).collect()
    assert all(x.train_tokens == 0 and x.base_score == 0 and x.held_out is None and x.n_known == 0 for x in none)
    assert recurrent.log_likelihoods(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_training_document_is_learned_from(spark, monkeypatch) -> None:
    r, turns = random.Random(5), []
    out = [i for i in range(60) if recurrent.held_out(i)]
    long = next(i for i in range(60) if i not in out)
    rows = [(grammar(r, 260_000), long, 1, "w"), *((grammar(r, 80), i, 1, "w") for i in out)]  # a single one to learn from, of over 800 KB
    learn = recurrent.learned

    def counted(*args) -> int:
        turns.append(learn(*args))
        return turns[-1]

    monkeypatch.setattr(recurrent, "learned", counted)
    got = recurrent.log_likelihoods(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sum(turns) == 2 * 260_001 == 2 * got[0].train_tokens  # a small corpus: two passes
    held = [x for x in got if x.held_out]
    gain = sum(x.score - x.base_score for x in held) / sum(x.n_tokens for x in held)
    assert len(held) > 5 and gain > 0.2, gain


def test_every_token_is_learned_once_a_pass(monkeypatch) -> None:
    n, r, seen = Network(small(), hidden=5), random.Random(9), []
    docs = [np.array([r.randrange(1, 15) for _ in range(r.randrange(30))], np.int32) for _ in range(40)]
    whole = n.learn
    monkeypatch.setattr(n, "learn", lambda before, token, *rest: (seen.extend(zip(before.ravel().tolist(), token.ravel().tolist(), strict=True)), whole(before, token, *rest))[1])
    monkeypatch.setattr(recurrent, "WINDOWS", 2)
    n.train(docs, streams=7, window=5)
    assert Counter(seen) == Counter(x for d in docs for x in zip([0, *d.tolist()], [*d.tolist(), 0], strict=True))
    assert np.isfinite(n.vector()).all()


def test_large_corpora_have_as_many_passes(spark, monkeypatch) -> None:
    turns, counts = [], recurrent.vocabulary
    monkeypatch.setattr(recurrent, "vocabulary", lambda *a: ((got := counts(*a))[0]._replace(tokens=1 << 40), got[1]))
    monkeypatch.setattr(recurrent, "learned", lambda network, rows, turn: turns.append(turn))
    assert recurrent.log_likelihoods(spark.createDataFrame([("a b", 1, 1, "w"), ("a", 7, 1, "w")], SCHEMA)).count() == 2
    assert turns == list(range(recurrent.ROUNDS * recurrent.PASSES))


def test_rounds_take_every_document_once(spark) -> None:
    n, r = Network(small(), hidden=5), random.Random(6)
    sizes = [[r.randrange(40) for _ in range(r.randint(1, 9))] for _ in range(7)]
    ids = [[r.choice([None, *range(30)]) for _ in s] for s in sizes]
    rows = [(i, [0] * len(s), [0.0] * len(s), [0.0] * len(s), s, np.array([r.randrange(15) for _ in range(sum(s))], "<u2").tobytes()) for i, s in zip(ids, sizes, strict=True)]
    before = n.vector()
    got = [recurrent.learned(n, spark.createDataFrame(rows, recurrent.READ_SCHEMA).repartition(3), turn) for turn in range(recurrent.ROUNDS)]
    assert sum(got) == sum(k + 1 for i, s in zip(ids, sizes, strict=True) for d, k in zip(i, s, strict=True) if not recurrent.held_out(d))
    assert n.vector().shape == before.shape and np.isfinite(n.vector()).all() and not np.array_equal(n.vector(), before)


def test_texts_are_split_once_and_stored_as_numbers(spark) -> None:
    r = random.Random(7)
    texts = [None, "", " \n\x0b", "Über über A b", *(" ".join(r.choice(["A", "b", f"W{r.randrange(400)}", "\n"]) for _ in range(r.randrange(60))) for _ in range(90))]
    docs = [(t, r.choice([None, i])) for i, t in enumerate(texts)]
    chunks = recurrent.tokenized(spark.createDataFrame(docs, "text string, doc_id long").repartition(3))
    assert {"text", "data"}.isdisjoint(chunks.columns)  # later passes read numbers
    got, times = [], Counter()
    for row in chunks.collect():
        words, token = [bytes(w) for w in row.words], recurrent.from_planes(bytes(row.tokens))
        assert len(set(words)) == len(words) == len(row.times) and words[-1] == END and len(token) == sum(row.sizes)
        got += [(i, tuple(words[t] for t in own)) for i, own in zip(row.ids, np.split(token, np.cumsum(row.sizes)[:-1]), strict=True)]
        times.update(dict(zip(words, row.times, strict=True)))
    of = [(i, tuple((t or "").encode().lower().split())) for t, i in docs]
    assert sorted(got, key=repr) == sorted(of, key=repr)
    assert +times == Counter(w for i, words in of if not recurrent.held_out(i) for w in (*words, END))


def test_sums_of_runs() -> None:
    rng = np.random.default_rng(5)
    for sizes in ([1], [30], [1, 1, 1], rng.integers(1, 25, 60), rng.integers(1, 4, 60), np.full(5, recurrent.SHORT), np.full(5, recurrent.SHORT + 1)):
        first = np.cumsum(sizes) - sizes
        rows = rng.normal(0, 1, (int(np.sum(sizes)), 7))
        assert np.allclose(recurrent.sums_of_runs(rows, first), np.add.reduceat(rows, first))


def test_outputs_beyond_the_range_of_small_numbers() -> None:
    n, rng = network(), np.random.default_rng(6)
    h, token = rng.uniform(-1, 1, (40, 5)), rng.integers(0, 15, 40)
    likely, (back, grads) = n.log_likelihood(h, token), n.output_gradients(h, token)
    for name in ("class_bias", "word_bias"):
        n.out[name] = n.out[name] + 200  # a softmax does not change
    for table in (n.gates, n.out):
        for k, p in table.items():
            table[k] = p.astype(np.float32)
    small_h = h.astype(np.float32)
    assert np.allclose(n.log_likelihood(small_h, token), likely, atol=1e-3)
    got = n.output_gradients(small_h, token)
    assert np.allclose(got[0], back, atol=1e-3) and all(np.allclose(got[1][k], g, atol=1e-2) for k, g in grads.items())
