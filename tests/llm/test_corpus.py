"""The corpus operators against brute-force versions, on small tables with nulls, copies, long and empty texts."""

from __future__ import annotations

import hashlib
import math
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from placegrid.llm import byte_suffixes, common, exchange, fingerprints, hashed, packing, pieces, quality_classifier, quality_rules, similar, simhash, toxicity, warc, word_blocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, key string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdeéß漢 "), rng.integers(2, 7))).strip() or "x" for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, long = text(60), text(3000)
    texts = [text(int(n)) for n in rng.integers(1, 150, 40)]
    texts += [texts[0], texts[1], texts[1] + " more", None, "", " \n\t", "a", long, long[:5000], text(20) + " " + passage, passage + " " + text(9), passage[:150] + "\n" + passage]
    texts += ["z" * 900, "ab " * 200, "<|endoftext|> Hello, WORLD's. Don't! 1234", "x\x00y　z ▁"]
    out = [(i * 3, t, None if i % 9 == 0 else "en", "s", 1, 7, "k") for i, t in enumerate(texts)]
    return [*out, out[2], (None, texts[3], "en", None, None, 1, "k"), (None, None, None, None, None, 1, "k")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def covers(sequences, size):
    count = Counter(s[i : i + size] for s in sequences for i in range(len(s) - size + 1))
    out = []
    for s in sequences:
        gone = bytearray(len(s))
        for i in range(len(s) - size + 1):
            if count[s[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append(gone)
    return out


def test_repeated_words(docs, rows, empty):
    words = [tuple((t or "").encode().split()) for _, t, *_ in rows]
    want = Counter((r[0], len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for r, w, g in zip(rows, words, covers(words, 35), strict=True))
    got = word_blocks.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want
    assert word_blocks.remove_repeats(empty).count() == 0


def test_repeated_bytes(docs, rows, empty):
    data = [(t or "").encode() for _, t, *_ in rows]
    want = Counter()
    for r, d, g in zip(rows, data, covers(data, 200), strict=True):
        spans = len([x for x in bytes(g).split(b"\0") if x])
        want[r[0], len(d), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(d, g, strict=True) if not y)).hexdigest()] += 1
    out = byte_suffixes.remove_repeats(docs, carry=("lang", "n_chars", "part", "text"))
    assert Counter(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want
    assert byte_suffixes.remove_repeats(empty).count() == 0


def test_merged_transforms_state_every_interval():
    rng, depth = np.random.default_rng(2), byte_suffixes.DEPTH
    shards = []
    for _ in range(5):
        rows = rng.integers(0, 3, (40, depth + 2)) if len(shards) % 2 else rng.integers(0, 2, (25, depth + 2)) * 7
        shards.append(exchange.distinct(rows[:, 0].astype(np.uint64), rows[:, 1:].astype(np.uint32))[0])
    every = [(int(k), *map(int, m), 1 + int(x)) for s in shards for k, m, x in zip(s.key, s.more, s.several, strict=True)]
    want = []
    for a in every:
        state = 0
        for d in range(1, depth + 1):
            same = [b for b in every if b[:d] == a[:d]]
            if sum(b[-1] for b in same) > 1:
                after = len({b[d] for b in same}) == 1
                state |= (3 if after and len({b[-2] for b in same}) == 1 else 2 if after else 1) << 2 * (d - 1)
        want.append(state)
    assert np.concatenate(byte_suffixes.merged(shards)).tolist() == want


def test_key_coding():
    rng = np.random.default_rng(3)
    for top in (1 << 8, 1 << 40, (1 << 64) - 1):
        key = np.unique(rng.integers(0, top, 500, dtype=np.uint64))
        assert (exchange.decoded(exchange.coded(key, 0), len(key), 0) == key).all()
    for bits in (1, 8):
        values = rng.integers(0, 1 << bits, 77).astype(np.uint8)
        assert (exchange.from_reply(exchange.to_reply(values, bits), 77, bits) == values).all()


def as_chunks(spark, per_task, n):
    rows = [(((t << 24) + i) >> exchange.HOME, (t << 24) + i, [t * 100 + i], [1], b"x", []) for t in range(n // per_task) for i in range(per_task)]
    return spark.createDataFrame(rows, exchange.CHUNK_SCHEMA).repartition(4)


def test_exchange_levels(spark):
    keys = {}
    rng = np.random.default_rng(13)
    for t in range(12):
        for i in range(3):
            k = rng.integers(0, 40, 30).astype(np.uint64) * np.uint64(0x5555555555555555 // 13)
            more = rng.integers(0, 2, (30, 1)).astype(np.uint32)
            got, _ = exchange.distinct(k, more)
            keys[(t << 24) + i] = got._replace(asked=rng.integers(0, 2, len(got.key)).astype(bool))
    times = Counter()
    for k in keys.values():
        for a, m, s in zip(k.key.tolist(), k.more[:, 0].tolist(), k.several.tolist(), strict=True):
            times[a, m] += 1 + s
    part = lambda c: (c.ids[0] // 100 << 24) + c.ids[0] % 100
    for ranges, fan in ((5, 256), (16, 4), (30, 3)):  # one, two and four levels
        out = exchange.exchanged(as_chunks(spark, 3, 36), "got", lambda c, _: keys[part(c)], ranges=ranges, fan=fan).select("part", "got").collect()
        assert len(out) == 36
        for r in out:
            k = keys[r["part"]]
            want = [times[a, m] > 1 for a, m, q in zip(k.key.tolist(), k.more[:, 0].tolist(), k.asked.tolist(), strict=True) if q]
            assert exchange.from_reply(bytes(r["got"]), len(want), 1).astype(bool).tolist() == want


def test_rows_of_a_sender_are_bounded():
    key = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2))
    assert all(len(exchange.rows_of(exchange.Keys(key), 0, (1, 0), n)) == min(n, exchange.FAN) for n in (17, 81, exchange.FAN))
    assert exchange.buckets(1 << 40) < 100_000


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = Counter((r[0], f, least.get(c)) for r, f, c in zip(rows, fps, label, strict=True))
    for hot in (simhash.HOT, 3):  # with 3 nearly every shard is split
        got = simhash.simhash_components(docs, hot=hot).collect()
        assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert simhash.simhash_components(empty).count() == 0


def test_bk_trees_find_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[:20] ^ (np.uint64(1) << rng.integers(0, 63, 20).astype(np.uint64))
    fps = np.concatenate([base, near, near ^ np.uint64(7)])
    label = simhash.shard_links(fps, np.zeros(len(fps), np.int64), 4)
    want = np.arange(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 4:
                want[want == max(want[i], want[j])] = min(want[i], want[j])
    assert (label == want).all()
    for equal in (1, 2, 3, 4):
        assert len(simhash.block_keys(equal, 4)) == [5, 15, 35, 70][equal - 1]


def test_split_shards_cover_all_bits():
    for parts in simhash.block_keys(2, 4):
        bits = [b for block in simhash.other_blocks(parts, 5) for shift, width in block for b in range(shift, shift + width)]
        assert sorted(bits + [b for s, w in parts for b in range(s, s + w)]) == list(range(64))


def test_only_heavy_keys_are_salted(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(300)] + [(None, 7)], "id long, k long")
    small = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).where("k <> 9").cache()
    got = common.salted_join(rows, small, "k", "id", heavy=20)
    want = rows.join(small.drop("n"), "k", "left")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select("id", "k", "m").collect()), key=key) == sorted(map(tuple, want.select("id", "k", "m").collect()), key=key)


def test_one_document_of_each_group(docs):
    ids = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and ids.count(None) == 2


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.best_fit_packing(docs, path).toPandas()
    t, want = Tokenizer.from_file(path), Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    key = lambda r: (None if pd.isna(r[0]) else int(r[0]), *map(int, r[1:]))
    assert Counter(key(r) for r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    assert packing.best_fit_packing(empty, path).count() == 0


def test_plan_uses_each_piece_once_and_packs_well():
    rng = np.random.default_rng(6)
    counts = np.bincount(rng.integers(1, 2049, 4000), minlength=2049)
    used, sequences = np.zeros(2049, np.int64), 0
    for parts, n in packing.planned(counts, 2048):
        assert n > 0 and sum(parts) <= 2048
        for p in parts:
            used[p] += n
        sequences += n
    assert (used == counts).all()
    assert sequences <= 1.01 * -(-(counts * np.arange(2049)).sum() // 2048) + 1
    counts = np.zeros(2049, np.int64)
    counts[[1500, 700, 650, 5]] = 500, 500, 500, 3
    assert sum(n for _, n in packing.planned(counts, 2048)) == 875  # 500 + 250 + 125


def test_fingerprints(docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = Counter()
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        own = r[1] or ""
        want[r[0], len(own), hashlib.sha256(fingerprints.edited_text(own, after[1] or "").encode()).hexdigest()] += 1
    got = fingerprints.document_fingerprints(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_text = {}
    text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert by_text.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1
    assert fingerprints.document_fingerprints(empty).count() == 0


def test_collision_rate_is_the_generalised_jaccard():
    rng = np.random.default_rng(7)
    term = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    a, b = rng.integers(1, 6, 40), rng.integers(1, 6, 40)
    sig = fingerprints.signatures([(term[:40], a), (term[10:], b)], 4096)
    wa, wb = dict(zip(term[:40].tolist(), a.tolist(), strict=True)), dict(zip(term[10:].tolist(), b.tolist(), strict=True))
    every = set(wa) | set(wb)
    true = sum(min(wa.get(x, 0), wb.get(x, 0)) for x in every) / sum(max(wa.get(x, 0), wb.get(x, 0)) for x in every)
    assert abs(fingerprints.likeness(*sig) - true) < 0.04


def scalar_sample(text, sample, samples=fingerprints.SAMPLES):
    """One sample of a text, term by term, with draws in double precision."""
    flow, top = (1 << 64) - 1, []
    unit = lambda h: ((h >> 40) + 0.5) * 2.0**-24
    seed = int(common.mix(np.array([(sample + 1) * 0x9E3779B97F4A7C15 & flow], np.uint64))[0])
    for word, weight in Counter(text.encode().split()).items():
        term, u = xxhash.xxh64_intdigest(word), []
        h = int(common.mix(np.array([term ^ seed], np.uint64))[0])
        for _ in range(5):
            h = h * 0x5851F42D4C957F2D + 0x14057B7EF767814F & flow
            u.append(unit(h ^ (h >> 29)))
        r, c = -math.log(u[0] * u[1]), -math.log(u[2] * u[3])
        t = math.floor(math.log(weight) / r + u[4])
        mark = int(common.mix(np.array([term + t * 0x9E3779B97F4A7C15 & flow], np.uint64))[0]) >> 48
        top.append((math.log(c) - r * (t - u[4]) - r, mark))
    return min(top)[1] if top else 0


def test_fingerprints_against_a_scalar_version(docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.document_fingerprints(docs).collect() if r["doc_id"] is not None}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], (r[1] or "").encode()))
    want, agree = {}, 0
    for i, t, *_ in order[::4]:
        if len(t or "") < 2000:
            want[i] = [scalar_sample(t or "", s) for s in range(fingerprints.SAMPLES)]
            print_ = got[i]["fingerprint"]
            agree += sum(int(print_[4 * s : 4 * s + 4], 16) == x for s, x in enumerate(want[i]))
    assert len(want) > 8 and agree / (len(want) * fingerprints.SAMPLES) > 0.999  # draws differ in the last bits only
    for r in got.values():
        own, edit = r["fingerprint"], r["edited_fingerprint"]
        assert abs(r["near_edited"] - sum(own[k : k + 4] == edit[k : k + 4] for k in range(0, len(own), 4)) / fingerprints.SAMPLES) < 1e-12


def test_ranges_of_ids(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), f"t{i}") for i in rng.choice(10**9, 300, replace=False)] + [(None, "n1"), (None, "n2"), (5, "x"), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted(((a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)))
    for table, pairs in ((docs, want), (docs.where("doc_id is not null"), None)):
        got = sorted((r["text"].decode(), r["next"].decode()) for r in fingerprints.following(table, 40).collect())
        assert got == pairs if pairs else len(got) == 302


def test_long_units_merge_like_the_library():
    import base64

    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = SentencePieceProcessor(model_file=path), pieces.Viterbi(path)
    rng = np.random.default_rng(1)
    texts = [base64.b64encode(rng.bytes(750_000)).decode(), "ab" * 3000, "é漢a" * 100, "z" * (pieces.LONG + 1), "z" * pieces.LONG]
    began = time.process_time()
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert time.process_time() - began < 30 and got == [lib.encode(t) for t in texts]


def test_sentencepiece(docs, rows, empty):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = SentencePieceProcessor(model_file=path)
    out = pieces.encoded(docs, path).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == Counter((r[0], tuple(lib.encode(r[1] or ""))) for r in rows)
    assert all(r["round_trip"] for r in out if r["doc_id"] != max(x[0] or 0 for x in rows))
    assert pieces.encoded(empty, path).count() == 0


def test_viterbi_on_a_unigram_model(tmp_path):
    from sentencepiece import SentencePieceProcessor

    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    at = data.rfind(b"\x18\x02")  # the model's type, the only place where the files differ
    path = tmp_path / "unigram.model"
    path.write_bytes(data[:at] + b"\x18\x01" + data[at + 2 :])
    lib, own = SentencePieceProcessor(model_file=str(path)), pieces.Viterbi(str(path))
    words = ["unbelievable", "Straßenbahn", "naïveté", "tokenizer", "a", "漢字", "international", "x1y2z3"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(words)] == lib.encode(words)


def test_measured_against_definitions(rows):
    for _, t, *_ in rows:
        data = (t or "").encode()
        words = data.split()
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in data.split(b"\n") if x.split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside))
        assert quality_rules.measured(data)[:5] == want


def test_binomial_bound():
    from math import comb

    for n, rate, risk in ((50, 0.1, 0.05), (400, 0.02, 0.01), (10, 0.01, 0.05)):
        tail = lambda k: sum(comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))  # noqa: B023, E731
        k = quality_rules.most_rejected(n, rate, risk)
        assert (k < 0 or tail(k) <= risk) and tail(k + 1) > risk


def test_rules_keep_good_documents(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 90, 3)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(docs, labels).toPandas()
    assert len(out) == docs.count() and (out["kept"] == ~out["base_failed"]).all()  # too few labels for any cutoff
    assert quality_rules.quality_rules(empty, labels).count() == 0
    hist = {(0, r): np.vstack([np.r_[np.zeros(150), 100, np.zeros(50)], np.r_[5000, np.zeros(200)]]).astype(int) for r in quality_rules.RULES}
    assert set(quality_rules.cutoffs(hist, 0.01, 0.05, 20.0).values()) == {149}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("aeiounrst"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(words, 40))
        bad, toxic = i % 4 == 0, i % 5 == 1
        if bad:
            text = [w.upper() + "!!" for w in text]
        if toxic:
            text[3] = "idiotic"
        rows.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_classifier_held_out(labelled):
    docs, labels = labelled
    out = quality_classifier.quality_scores(docs, labels).withColumn("held", quality_classifier.held_out()).join(labels, "doc_id").toPandas()
    assert [bool(h) for h in out["held"]] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]
    held = out[out["held"]]
    assert ((held["score"] >= 0.3) == (held["quality"] == 1)).mean() > 0.97


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    out = toxicity.toxicity(docs, labels.where("doc_id % 3 <> 0")).join(labels, "doc_id").where("doc_id % 3 = 0").toPandas()
    assert ((out["p_toxic"] > 0.5) == (out["toxic"] == 1)).mean() > 0.97
    assert (out["expected_severity"] >= out["p_toxic"] - 1e-9).all() and out["grade"].between(0, 2).all()


def test_scores_against_scalar_versions(labelled):
    docs, labels = labelled
    texts = dict(map(tuple, docs.collect()))
    data = hashed.sample(docs, labels.where(~quality_classifier.held_out()), "quality", 500, 1 << 20)
    folded, bias = quality_classifier.train(data)
    for r in quality_classifier.quality_scores(docs, labels, 500, 1 << 20).collect():
        total = count = 0.0
        for word, n in quality_classifier.counted(texts[r["doc_id"]].encode()).items():
            ids, _ = hashed.subwords([word], quality_classifier.BUCKETS)
            total, count = total + n * sum(float(folded[i]) for i in ids), count + n * len(ids)
        assert abs(r["score"] - 1 / (1 + math.exp(-(bias + total / count)))) < 1e-6
    data = hashed.sample(docs, labels, "toxic", 500, 1 << 20)
    found = [toxicity.features(t) for t in data["text"]]
    w, theta = toxicity.train(found, toxicity.graded(data, found))
    for r in toxicity.toxicity(docs, labels, 500, 1 << 20).collect():
        z = sum(float(w[f]) for f in {f for x in texts[r["doc_id"]].encode().split() for f in hashed.stems(x, toxicity.BUCKETS)})
        above = [1 - 1 / (1 + math.exp(-min(max(t - z, -40), 40))) for t in theta]
        assert abs(r["expected_severity"] - sum(above)) < 1e-6 and abs(r["p_toxic"] - above[0]) < 1e-6
        assert r["grade"] == sum(a > 0.5 for a in above)


def test_any_column_names_pass_through(docs, labelled):
    more = ["n_lines", "score", "nth", "_nth", "base_failed", "c0", "fp"]
    own = labelled[0].selectExpr("doc_id", "text", "'en' as lang", *(f"doc_id + {i} as {n}" for i, n in enumerate(more)))
    for out in (quality_rules.kept_documents(own, labelled[1]), quality_classifier.kept_documents(own, labelled[1]), simhash.one_of_each(own), similar.one_of_each(own)):
        assert out.columns == own.columns
        got = out.collect()
        assert got and all(r[n] == r["doc_id"] + i for r in got for i, n in enumerate(more))


def test_models_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.quality_scores(docs, none).count() == docs.count() == toxicity.toxicity(docs, none).count()
    assert quality_classifier.quality_scores(empty, none).count() == 0


def test_archives(spark):
    big, big2 = "é" * 700, "q" * 1200
    rows = [(1, "http://a.example.com/x?y=1#f", big), (5, "https://B.example.com:443/x", big), (3, None, big), (4, "u", "small"), (6, "u", "small"), (7, "http://[bad", None), (None, "u", big2), (None, "v", big2), (9, "http://a.example.com/x?y=1", "<p>\r\n\r\n</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.archived(pages).collect()
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 5
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == want
    assert warc.archived(pages.limit(0)).count() == 0
    assert warc.url_key("http://user@WWW.example.com:8080/a?b#c") == "com,example,www:8080)/a?b"


def test_pipeline(spark, tmp_path, labelled):
    import corpus_pipeline

    docs, labels = labelled
    both = docs.unionByName(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 1000)).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    both.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert not (set(out["doc_id"]) & {i for i in range(0, 400, 4)}) and not (set(out["doc_id"]) & set(range(1000, 1400)))
    assert len(set(out["doc_id"])) == 300


def test_pipeline_with_nulls_repeats_and_clashes(spark, tmp_path, labelled):
    import corpus_pipeline

    docs, labels = labelled
    rows = docs.where("doc_id < 120").selectExpr("doc_id", "text", "if(doc_id % 7 = 0, null, 'en') as lang", "cast(null as string) as source", "if(doc_id % 5 = 0, null, length(text)) as n_chars")
    good = rows.where("doc_id = 1")
    odd = spark.createDataFrame([(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, " \n", None, None, None), (None, None, None, None, None)], rows.schema)
    every = rows.unionByName(rows.where("doc_id < 9")).unionByName(odd).unionByName(good.withColumn("doc_id", F.lit(None).cast("long")))
    every = every.selectExpr("*", "1 as score", "2 as n_lines", "3 as node", "4 as part", "5 as label")
    every.write.parquet(str(tmp_path / "a/documents.parquet"))
    labels.write.parquet(str(tmp_path / "a/labels.parquet"))
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "a")).collect()]
    assert {i for i in ids if i is not None} == {i for i in range(120) if i % 4} and len(ids) == 91  # each once, and the copy without an id
    every.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    labels.write.parquet(str(tmp_path / "b/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_scratch_is_deleted(spark, docs):
    import glob

    before = set(common._made)
    out = simhash.simhash_components(docs)
    assert out.count() == docs.count()
    common.discard(out)
    made = [p for p in common._made if p not in before]
    folders = [p.removeprefix("file://") for p in made]
    assert len(made) <= 4 and all(glob.glob(f"{f}/*") for f in folders)
    for p in made:
        common.deleted(spark, p)
    assert not any(glob.glob(f"{f}*") for f in folders)
