"""Registered queries of the mechanisms beyond plain plans, with their SQL: pruned search, positions, second chances,
generations of ledgers, resumable and stateful streams, files, batched inference, observed usage, table functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placegrid import scratch
from placegrid.functions import sizes, tables
from placegrid.operators import attention, generations, ledger, observed, positions, search, secondchance
from placegrid.plans import fixtures as X
from placegrid.plans.oracles import _EXPAND, _JSON, _PATCHED, _VECTORS, _cleaned, _top, oracle_sql
from placegrid.sources import batched, files
from placegrid.streaming import incremental, limits, resumable

QUERIES: dict = {}
SQL: dict[str, str] = {}


def registered(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


# Search that prunes


@registered(f"WITH {_VECTORS} SELECT query, rank::INT AS rank, target, round(d2, 6) AS d2 FROM ({_top(10)})")
def knn_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The search by pivots and bounds, in blocks small enough for these tables to have many."""
    q, t = X.vectors(spark, sf)
    return search.knn(q, t, 10, block=64, small=0).select("query", "rank", "target", r6(F.col("d2")).alias("d2"))


_AFAR = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 0.015625::DOUBLE + 8000000::DOUBLE) AS v, label FROM embeddings),
qs AS (SELECT * FROM e WHERE vec_id % 10 = 0), ts AS (SELECT * FROM e WHERE vec_id % 10 <> 0)"""


@registered(f"WITH {_AFAR} SELECT query, rank::INT AS rank, target, round(d2 * 4096::DOUBLE, 5) AS d2 FROM ({_top(10)})")
def knn_far_from_origin(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of length 6.4e7 that lie within a fraction of each other."""
    q, t = (d.withColumn("features", F.transform("features", lambda x: x.cast("double") * F.lit(0.015625) + F.lit(8000000.0))) for d in X.vectors(spark, sf))
    return search.knn(q, t, 10, block=64, small=0).select("query", "rank", "target", F.round(F.col("d2") * 4096.0, 5).alias("d2"))


@registered("SELECT 'v' || query || '.jpg' AS item, string_agg('/db/v' || target || '.jpg', ';' ORDER BY rank) AS candidates, count(*) AS n FROM "
            f"(WITH {_VECTORS} {_top(100)}) WHERE query % 100 <> 50 GROUP BY query")  # fmt: skip
def rerank_tasks_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Queries without an answer yet, with the paths of their first hundred candidates."""
    q, t = X.vectors(spark, sf)
    name = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"), F.lit(".jpg"))
    found = search.knn(q, t, 100).select(name("query").alias("query"), "rank", name("target").alias("target"))
    items = X.table(spark, sf, "embeddings").select(name("vec_id").alias("item"))
    out = ledger.rerank_tasks(items, found, items.where("item like '%50.jpg'"), "/db")
    return out.select("item", F.array_join("candidates", ";").alias("candidates"), F.size("candidates").cast("long").alias("n"))


# Positions


@registered("SELECT page_id, row_number() OVER (ORDER BY url NULLS FIRST, page_id) - 1 AS position, lpad(((row_number() OVER (ORDER BY url NULLS FIRST, page_id) - 1) // 32)::VARCHAR, 6, '0') AS batch FROM pages")
def positions_by_url(spark: SparkSession, sf: str) -> DataFrame:
    """Positions and batches of pages in the order of their addresses."""
    rows = positions.numbered(X.table(spark, sf, "pages").select("page_id", "url"), "url", "page_id")
    return rows.select("page_id", "position", F.lpad(F.floor(F.col("position") / 32).cast("string"), 6, "0").alias("batch"))


@registered("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey * 1000003 % 999983 * 4000000007, o_orderkey) - 1 AS position FROM orders")
def positions_by_sparse_id(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of orders by a sparse number that many of them share."""
    rows = X.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 1000003 % 999983 * 4000000007).alias("id"))
    return positions.numbered(rows, "id", "o_orderkey").select("o_orderkey", "position")


@registered("SELECT doc_id, lpad(((row_number() OVER (ORDER BY text NULLS FIRST, doc_id) - 1) // 100)::VARCHAR, 6, '0') AS batch FROM documents")
def batches_by_text(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of a hundred documents in the order of their whole texts."""
    return positions.batched(X.table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id", size=100).select("doc_id", "batch")


# Second chances

#: Answers of which some are cut short or quoted wrongly (~ stands for a single quote), and some are none at all.
BROKEN_MATCHES = (
    "replace(CASE event_id % 7 WHEN 0 THEN '{~matches~:[{~image_number~:' || CAST(event_id AS VARCHAR(9)) || ',~confidence~:~low~},' "
    "WHEN 1 THEN 'Sure: {\"matches\":[{\"image_number\":1,\"confidence\":\"hi' WHEN 2 THEN 'no idea ' || CAST(event_id % 50 AS VARCHAR(9)) WHEN 3 THEN ' none' "
    f"WHEN 4 THEN '{{\"matches\":null' ELSE {X.MATCHES} END, '~', chr(39))"
)
#: Replies of which two in five lack their last brackets.
BROKEN_REPLY = f"CASE event_id % 5 WHEN 0 THEN left({X.POINTS}, length({X.POINTS}) - 1) WHEN 1 THEN 'I say ' || left({X.POINTS}, length({X.POINTS}) - 2) ELSE {X.REPLY} END"


def _second_chance(text: str, none_counts: bool) -> str:
    """CTEs r, c (cleaned), b (broken ones and what a model that balances brackets says), z (event_id, t, x: JSON or NULL, mended)."""
    balanced = (
        "list_reduce(list_prepend('0', string_split(s, '')), lambda a, e: CASE WHEN e = '\"' THEN (CASE WHEN a[1] = '0' THEN '1' ELSE '0' END) || a[2:] WHEN a[1] = '1' THEN a "
        "WHEN e = '[' THEN '0]' || a[2:] WHEN e = '{' THEN '0}' || a[2:] WHEN e IN (']', '}') AND len(a) > 1 THEN '0' || a[3:] ELSE a END)"
    )
    none = "lower(clean) = 'none'" if none_counts else "false"
    return f"""r AS (SELECT event_id, {text} AS t FROM events), {_cleaned('r')},
b AS (SELECT event_id, replace(clean, chr(39), '"') AS q FROM c WHERE NOT ({none}) AND NOT json_valid(clean)),
s AS (SELECT event_id, regexp_replace(rtrim(substr(q, least(CASE WHEN instr(q, '[') > 0 THEN instr(q, '[') ELSE 999999 END, CASE WHEN instr(q, '{{') > 0 THEN instr(q, '{{') ELSE 999999 END))), ',+$', '') AS s FROM b WHERE q LIKE '%[%' OR q LIKE '%{{%'),
f AS (SELECT event_id, s || CASE WHEN st[1] = '1' THEN '"' ELSE '' END || st[2:] AS t FROM (SELECT event_id, s, {balanced} AS st FROM s)), {_cleaned('f', 'f')},
z AS (SELECT r.event_id, r.t, CASE WHEN b.event_id IS NULL THEN c.clean WHEN json_valid(fc.clean) THEN fc.clean END AS x, b.event_id IS NOT NULL AND coalesce(json_valid(fc.clean), false) AS mended
      FROM r JOIN c ON r.event_id = c.event_id LEFT JOIN b ON r.event_id = b.event_id LEFT JOIN fc ON r.event_id = fc.event_id)"""


@registered(f"""WITH {_second_chance(BROKEN_MATCHES, False)},
mv AS (SELECT event_id, bool_and(json_type(i, '$.image_number') IS NOT NULL AND json_type(i, '$.confidence') IS NOT NULL) AS v FROM (SELECT event_id, unnest(json_extract(x, '$.matches[*]')) AS i FROM z WHERE json_type(x, '$.matches') = 'ARRAY') GROUP BY event_id)
SELECT z.event_id, x AS cleaned, coalesce(json_type(x) = 'OBJECT', false) AS format_verified, coalesce(json_type(x) = 'OBJECT' AND json_type(x, '$.matches') IS NOT NULL AND (json_type(x, '$.matches') = 'NULL' OR coalesce(v, true)), false) AS content_verified,
       CASE WHEN x IS NULL THEN t END AS original, mended FROM z LEFT JOIN mv ON z.event_id = mv.event_id""")
def top100_model_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Rerank answers, the broken ones put to a model once each."""
    rows = scratch.written(X.built(spark, sf, "events", "event_id", answer=BROKEN_MATCHES))  # as a table, which answers are
    return secondchance.top100_mended(rows, "answer", "mending", secondchance.mending_model).drop("answer", "model_error")


@registered(f"""WITH {_second_chance(BROKEN_REPLY, True)},
it AS (SELECT event_id, unnest(json_extract(x, '$[*]')) AS p FROM z WHERE json_valid(x) AND json_type(x) = 'ARRAY'),
v AS (SELECT event_id, bool_and(coalesce(json_array_length(p, '$.center') = 2 AND TRY_CAST(json_extract_string(p, '$.center[0]') AS DOUBLE) BETWEEN 0 AND 1 AND TRY_CAST(json_extract_string(p, '$.center[1]') AS DOUBLE) BETWEEN 0 AND 1
      AND TRY_CAST(json_extract_string(p, '$.weight') AS DOUBLE) BETWEEN 0 AND 2 AND json_type(p, '$.reasoning') = 'VARCHAR' AND trim(json_extract_string(p, '$.reasoning')) <> '', false)) AS v FROM it GROUP BY event_id),
k AS (SELECT event_id, x, mended, coalesce(lower(x) = 'none', false) AS none, {_JSON.format('x')} AS j FROM z)
SELECT k.event_id, CASE WHEN NOT none THEN x END AS result, none OR coalesce(json_type(j) = 'ARRAY', false) AS format_verified, none OR (coalesce(json_type(j) = 'ARRAY', false) AND coalesce(v, false)) AS content_verified,
       none AS no_weighting, mended FROM k LEFT JOIN v ON k.event_id = v.event_id""")
def reply_model_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Raw replies as point lists, the broken ones put to a model once each."""
    rows = scratch.written(X.built(spark, sf, "events", "event_id", reply=BROKEN_REPLY))
    return secondchance.repaired_by_model(rows, "reply", "mending", secondchance.mending_model).drop("reply", "model_error")


# Attention by annotation files


_ATTENTION_SQL = oracle_sql()["attention_dispatch"].replace("CASE WHEN json_type(t, '$.result') IS NOT NULL THEN json_extract(t, '$.result') ELSE t::JSON END AS d", "json_extract(t, '$.result') AS d")


@registered(_ATTENTION_SQL)
def attention_files(spark: SparkSession, sf: str) -> DataFrame:
    """Queries with the first of their annotation files; weights count only as a document's result."""
    rows = X.built(spark, sf, "events", "event_id", text=X.DOCUMENT)
    name = lambda *more: F.concat(F.lit("q"), F.col("event_id").cast("string"), *map(F.lit, more))
    queries = rows.select("event_id", name(".jpg").alias("basename"), F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(0.5).alias("ratio"))
    notes = rows.where("event_id % 3 <> 2")
    twice = notes.select(name(".json").alias("filename"), "text").unionByName(notes.where("event_id % 2 = 0").select(name(".jsonx").alias("filename"), F.lit("[]").alias("text")))
    out = attention.dispatched(attention.annotated(queries, twice), 4, 4, F.col("ratio"), wrapped=True)
    return out.select("event_id", "attention_status", r6(F.aggregate("attention", F.lit(0.0), lambda s, x: s + x) / 16).alias("mean"))


@registered("SELECT vec_id, c.i::INT AS channel, p.i::INT AS pos, round((embedding[p.i + 1]::DOUBLE - (CASE c.i WHEN 0 THEN 0.485 WHEN 1 THEN 0.456 ELSE 0.406 END)::DOUBLE) / (CASE c.i WHEN 0 THEN 0.229 WHEN 1 THEN 0.224 ELSE 0.225 END)::DOUBLE, 6) + 0.0 AS x FROM embeddings, range(0, 3) c(i), range(0, 64) p(i)")
def input_normalise_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Three channels of all values against the ImageNet statistics."""
    rows = X.table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.array(*map(F.lit, range(3)))).alias("channel"))
    out = rows.select("vec_id", "channel", F.posexplode(sizes.normalised(F.col("embedding"), F.col("channel"))).alias("pos", "x"))
    return out.select("vec_id", "channel", "pos", r6(F.col("x")).alias("x"))


# Ledgers and streams


@registered("SELECT item, m.s AS status, -m.a AS attempt FROM (SELECT l_orderkey AS item, min(struct_pack(a := -(l_linenumber::BIGINT * 1000000000 + l_partkey), s := l_returnflag)) AS m FROM lineitem GROUP BY l_orderkey)")
def ledger_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Three generations of a ledger, of which the newest loses a file: the one before it is loaded."""
    base = scratch.folder(spark)
    tries = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("status"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("attempt"))
    generations.saved(tries.where("status = 'N'"), base)
    whole = generations.saved(ledger.latest(tries), base)
    lost = generations.saved(tries.where("status <> 'N'"), base)
    scratch.deleted(spark, f"{lost.folder}/{min(lost.files)}")
    if generations.newest(spark, base) != whole:
        raise AssertionError("the damaged generation was not passed over")
    return generations.loaded(spark, base, whole.schema)


def _fails(item: str) -> str:
    if int(item) % 7 == 0:
        raise ValueError("seven")
    return f"r{item}"


@registered("SELECT o_orderkey::VARCHAR AS item, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN o_orderkey % 7 <> 0 THEN 'r' || o_orderkey END AS result, "
            "(CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 THEN 2 ELSE 1 END)::INT AS attempt FROM orders")  # fmt: skip
def resumable_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Orders arrive in two parts; the second run takes up what is new and what failed in the first."""
    base, rows = scratch.folder(spark), X.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("item"))
    for part in (0, 1):
        rows.where(F.col("item").cast("long") % 2 == part).write.mode("append").parquet(f"{base}/in")
        stream = incremental.increments(spark, f"{base}/in", rows.schema, 1)
        found = resumable.resumed(stream, f"{base}/ledger", f"{base}/checkpoint", _fails)
    return ledger.latest(found).select("item", "status", "result", "attempt")


@registered("WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT user_id, count(*) AS calls, count(*) FILTER (gap < 3000000) AS early, round(sum(gap) / 1000000.0, 3)::DOUBLE AS gaps FROM g GROUP BY user_id")
def rate_spacing_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The spacing audit over a stream that brings the calls in no order, in three batches, and then one far later."""
    base, rows = scratch.folder(spark), X.table(spark, sf, "events").select("ts", F.col("user_id").cast("string").alias("user_id"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", limits.STATE_STORE)
    try:
        rows.repartition(3, F.xxhash64("ts", "user_id")).write.parquet(f"{base}/in")
        for step in (0, 1):
            if step:  # moves the watermark past all calls
                rows.agg(F.max(F.col("ts") + F.expr("INTERVAL 8000 DAYS")).alias("ts")).select("ts", F.lit("-").alias("user_id")).write.mode("append").parquet(f"{base}/in")
            stream = limits.spaced(incremental.increments(spark, f"{base}/in", rows.schema, 1), "ts", "user_id", 20, "4000 days")
            incremental.drained(stream, f"{base}/out", f"{base}/checkpoint")
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.schema("key string, ts timestamp, gap_s double, early boolean").parquet(f"{base}/out").where("key <> '-'")
    return out.groupBy(F.col("key").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("calls"), F.count_if("early").alias("early"), F.round(F.sum("gap_s"), 3).alias("gaps"))


# Files, inference, usage, table functions


@registered("SELECT s_suppkey || '.json' AS name, octet_length(encode(s_name || chr(10)))::BIGINT AS bytes, s_name || chr(10) AS text FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey > 1")
def file_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as one file each, and those of one suffix read back; an attempt that failed left nothing."""
    folder = scratch.folder(spark)
    files.registered(spark)
    name = F.concat(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ".txt").otherwise(".json"))
    rows = X.spread(X.table(spark, sf, "supplier")).select(name.alias("name"), F.concat("s_name", F.lit("\n")).cast("binary").alias("content"))
    rows.write.format("smallfiles").mode("append").option("path", folder).save()
    read = spark.read.format("smallfiles").option("path", folder).load().where((F.col("suffix") == "json") & (F.col("basename") != "1.json"))
    return read.select(F.col("basename").alias("name"), "bytes", "text")


def _projection():
    matrix = np.array([[((o * 7 + i * 3) % 11 - 5) / 10 for i in range(64)] for o in range(8)])

    def model(contents: list[bytes]) -> list[list[float]]:
        if len(contents) > 8:
            raise MemoryError("out of memory")
        return (np.stack([np.frombuffer(c, "<f4") for c in contents]).astype(np.float64) @ matrix.T).tolist()

    return model


@registered("SELECT vec_id, o.i::INT AS pos, round(sum(((o.i * 7 + i.i * 3) % 11 - 5)::DOUBLE / 10 * embedding[i.i + 1]::DOUBLE), 3) + 0.0 AS x FROM embeddings, range(0, 8) o(i), range(0, 64) i(i) GROUP BY vec_id, o.i")
def batched_inference(spark: SparkSession, sf: str) -> DataFrame:
    """A last layer of 8 x 64 as a model that runs by batches and is short of memory."""
    rows = X.spread(X.table(spark, sf, "embeddings")).select(F.col("vec_id").cast("string").alias("path"), batched.packed(F.col("embedding")).alias("content"))
    out = batched.predicted(rows, _projection, 32).where("error is null")
    return out.select(F.col("path").cast("long").alias("vec_id"), F.posexplode("features").alias("pos", "x")).select("vec_id", "pos", (F.round(F.col("x").cast("double"), 3) + F.lit(0.0)).alias("x"))


@registered("SELECT count(*) AS rows, count(*) FILTER (role = 'system') AS failed, sum(CASE WHEN role IN ('user', 'system') THEN length(text) ELSE 0 END)::BIGINT AS prompt_tokens, sum(CASE WHEN role IN ('user', 'system') THEN 0 ELSE length(text) END)::BIGINT AS completion_tokens, 0::BIGINT AS thinking_tokens, sum(length(text))::BIGINT AS total_tokens, count(*) AS api_calls FROM conversations")
def usage_observed(spark: SparkSession, sf: str) -> DataFrame:
    """Usage and failures of a run, counted by the pass that writes it."""
    n, asks = F.length("text").cast("long"), F.col("role").isin("user", "system")
    rows = X.table(spark, sf, "conversations").select(
        F.when(F.col("role") == "system", "failed").otherwise("success").alias("status"), F.when(asks, n).otherwise(0).alias("prompt_tokens"), F.when(asks, 0).otherwise(n).alias("completion_tokens"), F.lit(0).cast("long").alias("thinking_tokens"), n.alias("total_tokens"), F.lit(1).cast("long").alias("api_calls"),
    )
    found = observed.written_with_usage(rows, scratch.folder(spark))
    return spark.createDataFrame([tuple(found[k] for k in ("rows", "failed", *observed.USAGE))], ", ".join(f"{k} long" for k in ("rows", "failed", *observed.USAGE)))


@registered(f"""WITH {_EXPAND}, a AS (SELECT conv_id, turn, regexp_split_to_array(expanded, '\\{{IMAGE_[0-9]+\\}}') AS t, regexp_extract_all(expanded, '\\{{IMAGE_([0-9]+)\\}}', 1) AS m FROM xp),
p AS (SELECT conv_id, turn, 2 * i AS o, 'text' AS kind, trim(t[i + 1]) AS value FROM (SELECT *, unnest(range(0, len(t))) AS i FROM a) UNION ALL SELECT conv_id, turn, 2 * i + 1, 'image', m[i + 1] FROM (SELECT *, unnest(range(0, len(m))) AS i FROM a))
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) - 1)::INT AS pos, kind, value FROM p WHERE CASE WHEN kind = 'image' THEN value::INT < 3 ELSE value <> '' END""")
def sql_prompt_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts cut into texts and images by a table function in SQL."""
    tables.registered(spark)
    rows = X.table(spark, sf, "conversations").select("conv_id", "turn", F.expr(X.spark_sql(X.MARKERS)).alias("prompt"))
    return spark.sql("SELECT d.conv_id, d.turn, p.* FROM {d} d, LATERAL prompt_parts(d.prompt, 3) p", d=rows)


@registered(f"WITH {_PATCHED} SELECT event_id, (ascii(key) - 65)::INT AS row, (key[2:]::INT - 1)::INT AS col, round(w, 6) AS w FROM pg")
def sql_grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of grids by a table function in SQL."""
    tables.registered(spark)
    return spark.sql("SELECT d.event_id, c.* FROM {d} d, LATERAL grid_cells(d.grid, 4) c", d=X.built(spark, sf, "events", "event_id", grid=X.GRID))
