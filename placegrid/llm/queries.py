"""The registered queries over the corpus tables: thin, they derive the digest columns from the operators' results."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placegrid.llm import byte_suffixes, fingerprints, packing, periodic, pieces, quality_classifier, quality_rules, recurrent, simhash, spelling, toxicity, warc, word_blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade and toxic (p_toxic over one half) of every document."""
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("toxic", (F.col("p_toxic") > 0.5).cast("int"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives."""
    out = warc.archived(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op5_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return word_blocks.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_sentencepiece_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, round_trip of every document."""
    out = pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip")


def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op8_merged_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return byte_suffixes.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every document."""
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shortened(doc: int | None, word: str) -> str:
    """The word without a code point if 31 divides the CRC-32 of ``<doc_id>:<word>``, which also says which one."""
    h = zlib.crc32(word.encode(), zlib.crc32(b"%d:" % doc)) if doc is not None else 1
    at = h % len(word)
    return word if h % 31 else word[:at] + word[at + 1 :]


def op11_trie_pair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of seven letters or more that occurs twice or more."""
    return spelling.spelling_variants(spelling.counted(table(spark, sf_dir, "documents"), shortened))


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth (by the CRC-32 h of the id) repeat a part of themselves from a word on to their end.

    From word a on, word i becomes word a + (i - a) % p, with g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeating(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeating(w)).otherwise("")), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every document."""
    out = periodic.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("f"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("f.less")
    return rows.select("doc_id", "n_runs", "f.start", length.alias("length"), "f.period", F.floor(1000 * length / F.col("f.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_recurrent_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return recurrent.log_likelihoods(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity_ordinal": op1_toxicity_ordinal,
        "op2_warc_index": op2_warc_index,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_weighted_fingerprints": op4_weighted_fingerprints,
        "op5_block_anchors": op5_block_anchors,
        "op6_sentencepiece_batched": op6_sentencepiece_batched,
        "op7_risk_controlled_rules": op7_risk_controlled_rules,
        "op8_merged_suffixes": op8_merged_suffixes,
        "op9_subword_quality": op9_subword_quality,
        "op10_simhash_bktree": op10_simhash_bktree,
        "op11_trie_pair_variants": op11_trie_pair_variants,
        "op12_periodic_minimizers": op12_periodic_minimizers,
        "op13_recurrent_language_model": op13_recurrent_language_model,
    }


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN m.keeper IS NULL OR m.keeper = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.keeper <> d.page_id THEN m.keeper END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest
"""

OP5_SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 34], ' ')) AS h, md5(array_to_string(w[i:i + 34], ' ')) AS m
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h, m) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
x AS (SELECT doc_id, j, w[j] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM t)),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.j = g.j GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Bytes as pairs of hexadecimal digits.
OP8_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM t WHERE len(x) >= 400)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS n FROM s) WHERE n > 1),
e AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e) GROUP BY doc_id, k),
d AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM g GROUP BY doc_id),
p AS (SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM (SELECT doc_id, lo, hi FROM g UNION ALL SELECT doc_id, -1, 0 FROM t)),
k AS (SELECT p.doc_id, string_agg(substr(x, 2 * p.lo + 1, 2 * (coalesce(p.hi, len(x) // 2) - p.lo)), '' ORDER BY p.lo) AS kept FROM p JOIN t ON p.doc_id = t.doc_id GROUP BY p.doc_id)
SELECT t.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM t JOIN k ON t.doc_id = k.doc_id LEFT JOIN d ON t.doc_id = d.doc_id
"""

#: The CRC-32 of texts of digits, by the table of its bytes (256 entries, made by rule).
CRC_SQL = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text; the table is ``crc``."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])))"


#: Neighbours by the texts that are left when one code point is taken out; forms are followed by recursion.
OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS raw FROM documents)),
low AS (SELECT doc_id, w, count(*) AS k FROM runs WHERE length(w) >= 7 GROUP BY doc_id, w),
x AS (SELECT w, k, hex(encode(doc_id || ':' || w)) AS x FROM low),
h AS (SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))) AS h FROM x, crc),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
dels AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT a.word, a.n, b.word AS less, b.n AS less_n FROM dels a JOIN words b ON a.d = b.word),
near AS (SELECT a.word, b.word AS near, b.n FROM dels a JOIN dels b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT word, less, less_n FROM shorter UNION ALL SELECT less, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, arg_max(near, n) AS one, max(n) AS n FROM near GROUP BY word),
first AS (SELECT b.word, min(near.near) AS near FROM best b JOIN near ON near.word = b.word AND near.n = b.n GROUP BY b.word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= 10 * w.n THEN f.near END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN first f ON w.word = f.word),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.at WHERE e.form IS NULL
"""

#: Lags up to 11 compare words; a longer lag of a run has 12 equal words in a row at least, so 12-word grams are joined.
OP12_SQL = f"""
WITH {CRC_SQL},
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc_sql("doc_id::VARCHAR")} AS h FROM documents, crc),
a AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM h),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM a),
short AS (SELECT doc_id, q, i FROM (SELECT doc_id, w, q, unnest(range(1, n - q + 1)) AS i FROM t, range(1, 12) AS r(q) WHERE n > q) WHERE w[i] = w[i + q]),
grams AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 11], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, n - 10)) AS i FROM t WHERE n >= 24)),
long AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.m = y.m AND y.i >= x.i + 12),
both_ AS (SELECT doc_id, q, i, 0 AS more FROM short UNION ALL SELECT doc_id, q, i, 11 FROM long),
s AS (SELECT doc_id, q, min(i) - 1 AS start, count(*) + max(more) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM both_) GROUP BY doc_id, q, g HAVING count(*) + max(more) + q >= greatest(12, 2 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
r AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start := start, length := length, period := period), [-length, start, period]) AS f, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period + 1, start + length + 1)) AS i FROM runs),
k AS (SELECT x.doc_id, string_agg(x.v, ' ' ORDER BY x.i) AS kept FROM (SELECT doc_id, w[i] AS v, i FROM (SELECT doc_id, w, unnest(range(1, n + 1)) AS i FROM t)) x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT t.doc_id, coalesce(r.n_runs, 0)::BIGINT AS n_runs, f.start::BIGINT AS start, f.length::BIGINT AS length, f.period::BIGINT AS period, (1000 * f.length // f.period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_index": OP2_SQL, "op5_block_anchors": OP5_SQL, "op8_merged_suffixes": OP8_SQL, "op11_trie_pair_variants": OP11_SQL, "op12_periodic_minimizers": OP12_SQL}
