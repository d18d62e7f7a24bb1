"""Queries over the driver tables, by name, and equivalent SQL.

`conversations` stand for messages, `documents` for facts (source as category, doc_id as time), `benchmark` for quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as fn
from lorekeep.operators import aggregate, dedup, distill, durable, extract, packing, providers, render, resume, stats, verify
from lorekeep.sources import driver_tables as tables
from lorekeep.sources import exports
from lorekeep.sources.schemas import CATEGORIES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The normalisation of F1 in the other dialect.
def norm(c: str) -> str:
    return f"trim(regexp_replace(lower(replace(translate(coalesce({c}, ''), '‘’“”—–', '''''\"\"--'), '…', '...')), '\\s+', ' ', 'g'))"


FACTS = "facts AS (SELECT doc_id AS fact_ord, text AS fact, source AS category, CAST(doc_id AS VARCHAR) AS convo, CAST(doc_id AS DOUBLE) AS ts FROM documents)"
GROUPED = f"""{FACTS}, grouped AS (SELECT {norm("fact")} AS norm, arg_max(fact, struct_pack(a := ts, b := -fact_ord)) AS fact, arg_max(coalesce(category, ''), struct_pack(a := ts, b := -fact_ord)) AS category,
 count(*) AS frequency, min(ts) AS min_timestamp, max(ts) AS max_timestamp, min(fact_ord) AS first_ord FROM facts GROUP BY 1)"""


@query(f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents").select("doc_id", fn.normalize_text("text").alias("norm"))


@query("SELECT doc_id, (length(coalesce(text, '')) + 3) // 4 AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents").select("doc_id", fn.token_estimate("text").alias("tokens"))


@query("SELECT count(DISTINCT conv_id) AS conversations, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, CAST(sum(length(text)) AS BIGINT) AS characters, false AS has_profile FROM conversations")
def conversation_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.export_stats(tables.conversations(spark, d), tables.messages(spark, d))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def visible_user_messages(spark: SparkSession, d: str) -> DataFrame:
    found = stats.visible_user_messages(tables.messages(spark, d))
    return found.select(F.col("conv_ord").alias("conv_id"), F.col("msg_ord").cast("long").alias("turn"), F.col("content").alias("text"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def conversation_text(spark: SparkSession, d: str) -> DataFrame:
    return render.conversation_text(tables.messages(spark, d)).select(F.col("conv_ord").alias("conv_id"), "text")


@query("SELECT coalesce(lang, '') || '-' || CAST(n_chars AS VARCHAR) AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    made = tables.table(spark, d, "documents").select(F.concat(F.coalesce("lang", F.lit("")), F.lit("-"), F.col("n_chars").cast("string")).alias("id"))
    return stats.duplicate_ids(made)


RENDERED = """rendered AS (SELECT conv_id, '=== Conversation: conv ' || conv_id || ' ===' || chr(10) || 'ID: ' || conv_id || chr(10) || 'Created: ' || conv_id || '.0' || chr(10) || chr(10)
 || string_agg('[' || upper(role[1]) || lower(role[2:]) || ']: ' || text || chr(10), chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id)"""


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    return render.render_conversations(tables.conversations(spark, d), tables.messages(spark, d))


@query(f"WITH {RENDERED} SELECT conv_id, rendered FROM rendered")
def render_conversation(spark: SparkSession, d: str) -> DataFrame:
    return _rendered(spark, d).select(F.col("conv_ord").alias("conv_id"), "rendered")


def _packed(spark: SparkSession, d: str, limit: int) -> DataFrame:
    sized = _rendered(spark, d).select(F.col("conv_ord").alias("part_ord"), fn.token_estimate("rendered").alias("tokens"))
    return packing.pack(sized, limit)


PACKED = f"""{RENDERED}, sized AS (SELECT conv_id, (length(rendered) + 3) // 4 AS tokens, row_number() OVER (ORDER BY conv_id) AS k FROM rendered),
fold(k, conv_id, tokens, chunk_id, used, open) AS (
 SELECT k, conv_id, tokens, CAST(0 AS BIGINT), CASE WHEN tokens > LIMIT THEN 0 ELSE tokens END, tokens <= LIMIT FROM sized WHERE k = 1
 UNION ALL
 SELECT s.k, s.conv_id, s.tokens,
  CASE WHEN s.tokens > LIMIT OR NOT f.open OR f.used + s.tokens > LIMIT THEN f.chunk_id + 1 ELSE f.chunk_id END,
  CASE WHEN s.tokens > LIMIT THEN 0 WHEN NOT f.open OR f.used + s.tokens > LIMIT THEN s.tokens ELSE f.used + s.tokens END,
  s.tokens <= LIMIT
 FROM fold f JOIN sized s ON s.k = f.k + 1)"""


@query("WITH RECURSIVE " + PACKED.replace("LIMIT", "800") + " SELECT conv_id, tokens, chunk_id FROM fold")
def pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, 800).select(F.col("part_ord").alias("conv_id"), "tokens", "chunk_id")


@query("WITH RECURSIVE " + PACKED.replace("LIMIT", "800") + " SELECT chunk_id, count(*) AS n_conversations, CAST(sum(tokens) AS BIGINT) AS tokens FROM fold GROUP BY chunk_id UNION ALL SELECT -1, count(*), CAST(sum(tokens) AS BIGINT) FROM fold")
def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    return stats.chunk_table(_packed(spark, d, 800), shown=None)


@query()
def split_conversations(spark: SparkSession, d: str) -> DataFrame:
    parts = packing.prepare(tables.conversations(spark, d), tables.messages(spark, d), _rendered(spark, d), 200)
    return parts.select("conv_ord", "part_num", "title", "msg_ord", "message_id", "content")


@query("WITH doc AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS p FROM documents) SELECT doc_id, count(*) AS paragraphs, CAST(sum((length(p) + 3) // 4) AS BIGINT) AS tokens FROM doc GROUP BY doc_id")
def paragraph_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = tables.table(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n\n")).alias("p"))
    return t.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(fn.token_estimate("p")).alias("tokens"))


def _aggregated(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.aggregate_facts(tables.facts(spark, d))


@query(f"WITH {GROUPED} SELECT norm, fact, category, frequency, min_timestamp, max_timestamp, first_ord FROM grouped")
def aggregate_facts(spark: SparkSession, d: str) -> DataFrame:
    return _aggregated(spark, d).select("norm", "fact", F.coalesce("category", F.lit("")).alias("category"), "frequency", "min_timestamp", "max_timestamp", "first_ord")


@query(f"WITH {GROUPED} SELECT CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE category END AS category, count(*) AS unique_facts, CAST(sum(frequency) AS BIGINT) AS mentions FROM grouped GROUP BY ROLLUP (category)")
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.category_summary(_aggregated(spark, d))


@query(f"WITH {GROUPED} SELECT CASE WHEN length(fact) > 60 THEN fact[1:60] || '...' ELSE fact END AS fact, category, frequency FROM grouped ORDER BY frequency DESC, first_ord LIMIT 10")
def top_facts(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_facts(_aggregated(spark, d))


@query(f"WITH {GROUPED} SELECT count(*) FILTER (frequency = 1) AS once, count(*) FILTER (frequency = 2) AS twice, count(*) FILTER (frequency >= 3) AS more FROM grouped")
def frequency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.frequency_histogram(_aggregated(spark, d))


@query(f"WITH {GROUPED} SELECT category, count(*) AS n FROM grouped GROUP BY category")
def category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return stats.category_breakdown(_aggregated(spark, d))


@query(f"WITH {GROUPED} SELECT category, min(first_ord) AS category_ord, count(*) AS n_facts FROM grouped GROUP BY category")
def group_by_category(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.group_by_category(_aggregated(spark, d)).select("category", "category_ord", F.size("facts").cast("long").alias("n_facts"))


@query(f"""WITH {GROUPED}, b AS (SELECT coalesce(category, '') AS category, count(*) AS b FROM facts GROUP BY 1), a AS (SELECT category, count(*) AS a FROM grouped GROUP BY 1),
j AS (SELECT coalesce(b.category, a.category) AS category, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM b FULL JOIN a ON a.category = b.category)
SELECT CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE category END AS category, CAST(sum(b) AS BIGINT) AS n_before, CAST(sum(a) AS BIGINT) AS n_after, CAST(sum(b) - sum(a) AS BIGINT) AS n_reduced,
 round((1 - CAST(sum(a) AS DOUBLE) / sum(b)) * 100, 1) AS percent FROM j GROUP BY ROLLUP (category)""")
def reduction_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.reduction_summary(tables.facts(spark, d), _aggregated(spark, d))


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as claims about document 0: most are found elsewhere, or nowhere."""
    t = tables.table(spark, d, "benchmark")
    return t.select(F.col("item_id").alias("fact_ord"), F.col("text").alias("fact"), F.lit("0").alias("source_convo_id"), F.col("text").alias("source_quote"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    t = tables.table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("conv_ord"), F.col("doc_id").cast("string").alias("conv_id"), "text")


@query(f"WITH q AS (SELECT item_id, {norm('text')} AS quote FROM benchmark), t AS (SELECT doc_id, {norm('text')} AS norm FROM documents) SELECT item_id, doc_id FROM q JOIN t ON contains(norm, quote) AND quote <> ''")
def verify_exact(spark: SparkSession, d: str) -> DataFrame:
    texts = durable.stored(_texts(spark, d).select(F.col("conv_ord").alias("text_ord"), fn.normalize_text("text").alias("norm")).filter("norm != ''"))
    q = tables.table(spark, d, "benchmark").select("item_id", fn.normalize_text("text").alias("quote"))
    return verify.containing(q, texts).join(q, "quote").select("item_id", F.col("text_ord").alias("doc_id"))


CHECKED = f"""q AS (SELECT item_id, {norm("text")} AS quote FROM benchmark), t AS (SELECT doc_id, {norm("text")} AS norm FROM documents),
 checked AS (SELECT item_id, (SELECT count(*) FROM t WHERE doc_id = 0 AND contains(norm, quote)) > 0 AS own, (SELECT min(doc_id) FROM t WHERE contains(norm, quote)) AS other FROM q),
 resolved AS (SELECT item_id, CASE WHEN own THEN 'own_exact' WHEN other IS NOT NULL THEN 'other_exact' ELSE 'discarded' END AS resolution, CASE WHEN own OR other IS NULL THEN '0' ELSE CAST(other AS VARCHAR) END AS source_convo_id FROM checked)"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return verify.verify(_quotes(spark, d), _texts(spark, d), fuzzy=False)


@query(f"WITH {CHECKED} SELECT item_id, resolution, source_convo_id, CASE WHEN resolution = 'discarded' THEN 'NOT FOUND' ELSE 'FOUND (exact)' END AS match_location FROM resolved")
def verify_all(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select(F.col("fact_ord").alias("item_id"), "resolution", "source_convo_id", "match_location")


@query(f"WITH {CHECKED} SELECT item_id, '0' AS claimed_convo_id, source_convo_id FROM resolved WHERE resolution = 'other_exact'")
def verify_wrong_id(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).filter("resolution = 'other_exact'").select(F.col("fact_ord").alias("item_id"), "claimed_convo_id", "source_convo_id")


@query(f"WITH {CHECKED} SELECT item_id, '[NOT FOUND] Fact: ''' || b.text[1:100] || '...''' || chr(10) || '  Quote: ''' || b.text[1:100] || '...''' || chr(10) || '  Conversation: 0' AS line FROM resolved JOIN benchmark b USING (item_id) WHERE resolution = 'discarded'")
def verify_discarded(spark: SparkSession, d: str) -> DataFrame:
    return verify.discarded(_checked(spark, d)).select(F.col("fact_ord").alias("item_id"), "line")


@query(f"WITH {CHECKED} SELECT resolution, count(*) AS n FROM resolved GROUP BY resolution")
def verify_summary(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).groupBy("resolution").agg(F.count("*").alias("n"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence or line of the user turns, with its own order: conversation, turn, place."""
    m = tables.messages(spark, d).filter("role = 'user'")
    each = m.select("*", F.posexplode(F.split("content", "[.\n]")).alias("place", "cut")).withColumn("sentence", F.trim("cut")).filter("sentence != ''")
    return each.withColumn("fact_ord", (F.col("conv_ord") * 100_000 + F.col("msg_ord")) * 1_000_000 + F.col("place"))


@query()
def verify_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Claims drawn from every sentence of the user turns, with a letter changed, some about the wrong conversation."""
    m = _sentences(spark, d)
    quote = F.regexp_replace("sentence", "e", "x")
    claimed = F.when(F.col("msg_ord") % 2 == 0, F.col("conv_id")).otherwise((F.col("conv_ord") + 1).cast("string"))
    claims = m.select("fact_ord", F.col("sentence").alias("fact"), claimed.alias("source_convo_id"), quote.alias("source_quote"))
    found = verify.verify(claims, render.conversation_text(tables.messages(spark, d)))
    return found.select("fact_ord", "claimed_convo_id", "source_convo_id", "resolution", "match_location")


@query(f"WITH {GROUPED} SELECT category, first_ord, CAST((row_number() OVER (PARTITION BY category ORDER BY max_timestamp, first_ord) - 1) // 50 AS BIGINT) AS batch FROM grouped")
def dedup_batches(spark: SparkSession, d: str) -> DataFrame:
    return dedup.batches(_aggregated(spark, d)).select(F.coalesce("category", F.lit("")).alias("category"), "first_ord", F.col("batch").cast("long").alias("batch"))


@query(f"WITH {GROUPED}, r AS (SELECT *, row_number() OVER (PARTITION BY category, norm ORDER BY max_timestamp DESC, length(fact) DESC, frequency DESC, first_ord) AS r FROM grouped) SELECT category, fact, frequency FROM r WHERE r = 1")
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_exact(_aggregated(spark, d)).select(F.coalesce("category", F.lit("")).alias("category"), "fact", "frequency")


def _lines_as_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of the user turns as a fact of the taxonomy's categories, by turn."""
    m = _sentences(spark, d)
    kind = F.get(F.array(*map(F.lit, CATEGORIES)), (F.col("msg_ord") % len(CATEGORIES)).cast("int"))
    return m.select("fact_ord", F.col("sentence").alias("fact"), kind.alias("category"), F.col("conv_id").alias("source_convo_id"), (F.col("conv_ord") * 86400.0).alias("source_timestamp"), F.col("sentence").alias("source_quote"))


@query()
def dedup_deterministic(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicate(aggregate.aggregate_facts(_lines_as_facts(spark, d)))


@query("""WITH f AS (SELECT conv_id * 1000 + turn AS ord, string_split(text, '.')[1] AS fact, turn % 8 AS k FROM conversations WHERE role = 'user')
SELECT CAST(k + 1 AS INTEGER) AS category_ord, (['identity', 'values', 'emotions', 'relationships', 'growth', 'history', 'practices', 'shadows'])[k + 1] AS category, ord, fact FROM f""")
def profile_categories(spark: SparkSession, d: str) -> DataFrame:
    # The SQL takes the first sentence of each turn alone, and so does this.
    m = tables.messages(spark, d).filter("role = 'user'")
    kind = F.get(F.array(*map(F.lit, CATEGORIES)), (F.col("msg_ord") % len(CATEGORIES)).cast("int"))
    facts = m.select((F.col("conv_ord") * 1000 + F.col("msg_ord")).alias("ord"), F.substring_index("content", ".", 1).alias("fact"), kind.alias("category"), F.lit("").alias("period"))
    return distill.profile_facts(facts).drop("period")


@query()
def distilled_profile(spark: SparkSession, d: str) -> DataFrame:
    deduped = dedup.dedup_categories(aggregate.aggregate_facts(_lines_as_facts(spark, d)))
    return distill.markdown(distill.distill(deduped, source="driver tables", generated="1970-01-01"))


@query()
def extract_facts(spark: SparkSession, d: str) -> DataFrame:
    assigned = _packed(spark, d, 800).join(_rendered(spark, d).select(F.col("conv_ord").alias("part_ord"), "rendered"), "part_ord")
    return extract.fact_rows(extract.extract(render.render_chunks(assigned), providers.Offline, providers.max_concurrent()))


@query("WITH RECURSIVE " + PACKED.replace("LIMIT", "800") + " SELECT DISTINCT chunk_id FROM fold WHERE chunk_id % 3 <> 0")
def remaining_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = _packed(spark, d, 800).select("chunk_id").distinct()
    done = chunks.filter("chunk_id % 3 = 0")
    return resume.remaining(chunks, done)


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') AS period FROM events GROUP BY user_id")
def period_string(spark: SparkSession, d: str) -> DataFrame:
    t = tables.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").cast("double").alias("a"), F.max("ts").cast("timestamp").cast("double").alias("b"))
    return t.select("user_id", fn.period("a", "b").alias("period"))


@query("SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' bytes' WHEN b < 1048576 THEN printf('%.1f', b / 1024.0) || ' KB' WHEN b < 1073741824 THEN printf('%.2f', b / 1048576.0) || ' MB' ELSE printf('%.2f', b / 1073741824.0) || ' GB' END AS size FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 37 + o_custkey) AS b FROM orders)")
def human_size(spark: SparkSession, d: str) -> DataFrame:
    t = tables.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 37 + F.col("o_custkey")).alias("b"))
    return t.select("o_orderkey", fn.human_size("b").alias("size"))


@query("SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%.1f', CAST(s AS DOUBLE)) || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS elapsed FROM (SELECT o_orderkey, o_orderkey % 9000 AS s FROM orders)")
def human_elapsed(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "orders").select("o_orderkey", fn.human_elapsed(F.col("o_orderkey") % 9000).alias("elapsed"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS text FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents").select("doc_id", fn.truncate("text", 80).alias("text"))


@query("SELECT item_id, sha256(text)[1:12] AS short FROM benchmark")
def short_hash(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "benchmark").select("item_id", F.substring(F.sha2("text", 256), 1, 12).alias("short"))


@query("SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, text FROM conversations")
def parse_flat_export(spark: SparkSession, d: str) -> DataFrame:
    """The table as a flat export, one file a conversation, and read back."""
    c = tables.table(spark, d, "conversations")
    message = F.struct(F.col("turn").cast("string").alias("uuid"), F.lit("").alias("text"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.lit("2024-01-02T03:04:05Z").alias("created_at"), F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    each = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("m"))
    raw = F.to_json(F.array(F.struct(F.col("conv_id").cast("string").alias("uuid"), F.lit("t").alias("name"), F.lit("2024-01-02T03:04:05Z").alias("created_at"), F.transform("m", lambda x: x["m"]).alias("chat_messages"))))
    made = each.select(F.format_string("%012d", "conv_id").alias("path"), raw.alias("raw"))
    found = exports.parse(made, exports.FLAT_EXPORT)[1]
    return found.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), "role", F.col("content").alias("text"))


def _trees(spark: SparkSession, d: str, branch: bool) -> DataFrame:
    """Each conversation as a tree along its turns; with branch, every node also has a second child that leads nowhere."""
    c = tables.table(spark, d, "conversations")
    order = F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn)")
    c = c.withColumn("k", order).withColumn("n", F.expr("count(*) OVER (PARTITION BY conv_id)"))
    content = F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts"))
    said = F.struct(F.col("turn").cast("string").alias("id"), F.struct("role").alias("author"), content.alias("content"))
    nexts = F.when(F.col("k") < F.col("n"), F.array((F.col("k") + 1).cast("string"), *([F.concat(F.lit("x"), F.col("k"))] if branch else []))).otherwise(F.array().cast("array<string>"))
    node = F.struct(F.when(F.col("k") > 1, (F.col("k") - 1).cast("string")).alias("parent"), nexts.alias("children"), said.alias("message"))
    nodes = [F.struct(F.col("k").cast("string").alias("key"), node.alias("value"))]
    if branch:
        side = F.struct(F.col("k").cast("string").alias("parent"), F.array().cast("array<string>").alias("children"), said.alias("message"))
        nodes.append(F.struct(F.concat(F.lit("x"), F.col("k")).alias("key"), side.alias("value")))
    each = c.select("conv_id", F.explode(F.array(*nodes)).alias("e")).groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list("e"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))).alias("mapping"))
    raw = F.to_json(F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit(0.0).alias("create_time"), "mapping")))
    return each.select(F.format_string("%012d", "conv_id").alias("path"), raw.alias("raw"))


def _tree_rows(made: DataFrame) -> DataFrame:
    found = exports.parse(made, exports.TREE_EXPORT)[1]
    return found.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), "role", F.col("content").alias("text"))


@query("SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, text FROM conversations")
def parse_tree_export(spark: SparkSession, d: str) -> DataFrame:
    return _tree_rows(_trees(spark, d, False))


@query("SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, text FROM conversations")
def flatten_branching(spark: SparkSession, d: str) -> DataFrame:
    return _tree_rows(_trees(spark, d, True))


@query("SELECT 'chatgpt' AS export_type, count(DISTINCT conv_id) AS n FROM conversations")
def detect_exports(spark: SparkSession, d: str) -> DataFrame:
    return exports.detect(_trees(spark, d, False)).groupBy("export_type").agg(F.count("*").alias("n"))


@query()
def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    t = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return dedup.cluster_by_embedding(t)
