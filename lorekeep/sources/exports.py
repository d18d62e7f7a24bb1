"""Readers of chat exports: message trees, flat message lists and curated memories.

An export is one JSON document with an array; its order counts, so it is read as whole text and taken apart with its
positions. Different files are read in parallel: pass a folder or a pattern, and conversations are ordered by file, then
by place. Schemas are given, never inferred: a message map would turn into a column for every message.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TREE = """array<struct<id:string, title:string, create_time:double, mapping:map<string, struct<parent:string, children:array<string>,
 message:struct<id:string, author:struct<role:string>, create_time:double, metadata:struct<is_visually_hidden_from_conversation:boolean>,
 content:struct<content_type:string, parts:array<variant>, text:string, user_profile:string, user_instructions:string>>>>>>"""
FLAT = """array<struct<uuid:string, name:string, created_at:string,
 chat_messages:array<struct<uuid:string, text:string, sender:string, created_at:string, content:array<struct<type:string, text:string>>>>>>"""
MEMORIES = "array<struct<conversations_memory:string, account_uuid:string, project_memories:map<string, variant>>>"
TREE_EXPORT, FLAT_EXPORT, UNKNOWN = "chatgpt", "claude", "unknown"


def load_export(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw): each file as one text. A missing path raises."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def export_type(raw: Column | str) -> Column:
    """By the first element only: one with a mapping object, one with uuid and chat_messages, or unknown."""
    first = F.expr(f"try_variant_get(try_parse_json({raw}), '$[0]')") if isinstance(raw, str) else F.try_variant_get(F.try_parse_json(raw), "$[0]", "variant")
    kind = lambda p: F.schema_of_variant(F.try_variant_get(first, p, "variant"))
    has = lambda p: F.try_variant_get(first, p, "variant").isNotNull()
    return F.when(kind("$.mapping").startswith("OBJECT"), TREE_EXPORT).when(has("$.uuid") & has("$.chat_messages"), FLAT_EXPORT).otherwise(UNKNOWN)


def detect(exports: DataFrame) -> DataFrame:
    return exports.withColumn("export_type", export_type(F.col("raw")))


def is_supported(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).isin(TREE_EXPORT, FLAT_EXPORT)


def iso_seconds(text: Column, fallback: Column) -> Column:
    """Epoch seconds of an ISO-8601 time, UTC where it names no zone; what cannot be read takes the fallback."""
    return F.coalesce(F.try_to_timestamp(text).cast("double"), fallback)


def main_path(mapping: Column) -> Column:
    """The nodes from the first root along each first child. Bounded by the map's size, so a cycle ends."""
    entries = F.map_entries(mapping)
    root = F.get(F.filter(entries, lambda e: e["value"]["parent"].isNull()), F.lit(0))["key"]
    empty = F.array().cast("array<string>")
    start = F.struct(root.alias("at"), empty.alias("path"))

    def step(state, _):
        node = F.try_element_at(mapping, state["at"])
        go = state["at"].isNotNull() & node.isNotNull() & ~F.array_contains(state["path"], F.coalesce(state["at"], F.lit("")))
        return F.struct(F.when(go, F.get(node["children"], F.lit(0))).alias("at"), F.when(go, F.array_append(state["path"], state["at"])).otherwise(state["path"]).alias("path"))

    size = F.greatest(F.coalesce(F.size(mapping), F.lit(0)), F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), size), start, step)["path"]


def _tree_content(c: Column) -> Column:
    """Only string parts count. Contents of an unknown kind are told as JSON."""
    texts = F.filter(F.coalesce(c["parts"], F.expr("cast(array() AS array<variant>)")), lambda p: F.schema_of_variant(p) == "STRING")
    joined = F.array_join(F.transform(texts, lambda p: F.try_variant_get(p, "$", "string")), "")
    blank = F.lit("")
    return (
        F.when(c["content_type"].isin("text", "multimodal_text"), joined)
        .when(c["content_type"] == "user_editable_context", F.concat(F.coalesce(c["user_profile"], blank), F.lit("\n"), F.coalesce(c["user_instructions"], blank)))
        .when(c["content_type"] == "code", F.coalesce(c["text"], blank))
        .otherwise(F.to_json(c))
    )


def _ordered(exports: DataFrame, schema: str) -> DataFrame:
    each = exports.select("path", F.posexplode(F.from_json("raw", schema)).alias("_at", "c"))
    # One row for each conversation: the place in the file, and files by path, make one order without a sort of texts.
    files = exports.select("path", F.coalesce(F.json_array_length("raw"), F.size(F.from_json("raw", schema)), F.lit(0)).alias("n"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return each.join(files, "path").withColumn("conv_ord", (F.col("_before") + F.col("_at")).cast("long"))


def _parse_tree(exports: DataFrame, run_ts: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    each = _ordered(exports, TREE)
    conversations = each.select("conv_ord", F.coalesce("c.id", F.lit("")).alias("id"), F.coalesce("c.title", F.lit("Untitled")).alias("title"), F.coalesce("c.create_time", F.lit(0.0)).alias("create_time"))
    nodes = each.select("conv_ord", F.coalesce("c.id", F.lit("")).alias("conv_id"), F.col("c.mapping").alias("m")).filter("m IS NOT NULL")
    found = nodes.select("conv_ord", "conv_id", F.posexplode(F.filter(F.transform(main_path(F.col("m")), lambda k: F.try_element_at(F.col("m"), k)["message"]), lambda x: x.isNotNull())).alias("msg_ord", "x"))
    hidden = F.coalesce(F.col("x.metadata.is_visually_hidden_from_conversation"), F.lit(False)) | (F.coalesce(F.col("x.content.content_type"), F.lit("")) == "user_editable_context")
    messages = found.select("conv_ord", "conv_id", "msg_ord", F.coalesce("x.id", F.lit("")).alias("id"), F.coalesce("x.author.role", F.lit("unknown")).alias("role"), _tree_content(F.col("x.content")).alias("content"), F.col("x.create_time").alias("timestamp"), hidden.alias("is_hidden"))
    contexts = nodes.select("conv_ord", F.posexplode(F.map_entries("m")).alias("node_ord", "e")).select("conv_ord", "node_ord", F.col("e.value.message.content").alias("x"))
    profile = contexts.filter("x.content_type = 'user_editable_context'").agg(F.min_by(F.struct(F.coalesce("x.user_profile", F.lit("")).alias("user_profile"), F.coalesce("x.user_instructions", F.lit("")).alias("user_instructions")), F.struct("conv_ord", "node_ord")).alias("p")).filter("p IS NOT NULL").select("p.*")
    return conversations, messages, profile


def _parse_flat(exports: DataFrame, run_ts: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    each = _ordered(exports, FLAT).withColumn("create_time", iso_seconds(F.col("c.created_at"), F.lit(run_ts)))
    title = F.coalesce(F.nullif(F.col("c.name"), F.lit("")), F.lit("Untitled"))
    conversations = each.select("conv_ord", F.coalesce("c.uuid", F.lit("")).alias("id"), title.alias("title"), "create_time")
    found = each.select("conv_ord", F.coalesce("c.uuid", F.lit("")).alias("conv_id"), "create_time", F.posexplode("c.chat_messages").alias("msg_ord", "x")).filter("x IS NOT NULL")
    parts = F.array_join(F.transform(F.coalesce("x.content", F.expr("cast(array() AS array<struct<type:string,text:string>>)")), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    role = F.when(F.col("x.sender") == "human", "user").otherwise(F.coalesce("x.sender", F.lit("unknown")))
    messages = found.select("conv_ord", "conv_id", "msg_ord", F.coalesce("x.uuid", F.lit("")).alias("id"), role.alias("role"), F.coalesce(F.nullif(parts, F.lit("")), F.col("x.text"), F.lit("")).alias("content"), iso_seconds(F.col("x.created_at"), F.col("create_time")).alias("timestamp"), F.lit(False).alias("is_hidden"))
    return conversations, messages, each.sparkSession.createDataFrame([], "user_profile string, user_instructions string")


#: Parsers by type: register another format here.
PARSERS: dict[str, Callable[[DataFrame, float], tuple[DataFrame, DataFrame, DataFrame]]] = {TREE_EXPORT: _parse_tree, FLAT_EXPORT: _parse_flat}


def parse(exports: DataFrame, kind: str, run_ts: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, profile) of exports of one kind. run_ts stands in for times that cannot be read."""
    if kind not in PARSERS:
        raise ValueError(f"Unknown export type: {kind}")
    return PARSERS[kind](exports, run_ts)


def read_export(spark: SparkSession, path: str, run_ts: float = 0.0) -> tuple[str, DataFrame, DataFrame, DataFrame]:
    """Load, detect and parse: (type, conversations, messages, profile). All files at the path must be of one type."""
    exports = load_export(spark, path)
    kinds = [r.export_type for r in detect(exports).select("export_type").distinct().limit(2).collect()]
    if len(kinds) != 1:
        raise ValueError(f"files of {len(kinds)} types at {path}")
    return kinds[0], *parse(exports, kinds[0], run_ts)


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """One row (conversations_memory, project_memories, account_uuid), or none where the file is missing, malformed or empty."""
    shape = "conversations_memory string, project_memories map<string,string>, account_uuid string"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], shape)
    first = spark.read.text(path, wholetext=True).select(F.get(F.from_json("value", MEMORIES), F.lit(0)).alias("m")).filter("m IS NOT NULL")
    fields = F.map_entries(F.coalesce(F.try_variant_get("v", "$", "map<string,variant>"), F.expr("cast(map() AS map<string,variant>)")))
    kept = F.filter(fields, lambda e: (e["key"] != "uuid") & (F.schema_of_variant(e["value"]) == "STRING"))
    prose = F.array_join(F.transform(kept, lambda e: F.concat(F.lit("**"), e["key"], F.lit("**\n\n"), F.try_variant_get(e["value"], "$", "string"))), "\n\n")
    each = first.select("m", F.posexplode_outer(F.map_entries("m.project_memories")).alias("at", "e")).select("m", "at", F.col("e.key").alias("k"), F.col("e.value").alias("v"))
    kind = F.schema_of_variant("v")
    each = each.withColumn("s", F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).when(kind.startswith("OBJECT"), prose))
    found = each.groupBy(F.col("m.conversations_memory").alias("c"), F.col("m.account_uuid").alias("a")).agg(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("at", "k", "s")))).alias("p"))
    found = found.select(F.coalesce("c", F.lit("")).alias("conversations_memory"), F.map_from_entries(F.transform("p", lambda x: F.struct(x["k"], x["s"]))).alias("project_memories"), F.coalesce("a", F.lit("")).alias("account_uuid"))
    return found.filter("conversations_memory != '' OR size(project_memories) > 0")


def memories_path(spark: SparkSession, path: str) -> str | None:
    """memories.json in the folder, or beside the file, if there is one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    folder = hadoop if fs.exists(hadoop) and fs.getFileStatus(hadoop).isDirectory() else hadoop.getParent()
    found = spark._jvm.org.apache.hadoop.fs.Path(folder, "memories.json")
    return found.toString() if fs.exists(found) else None


def validate_input(spark: SparkSession, path: str) -> tuple[bool, int, str]:
    """(valid, bytes, error) of an input file."""
    if not path or not path.strip():
        return False, 0, "no input path"
    at = spark._jvm.org.apache.hadoop.fs.Path(path.strip())
    try:
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return False, 0, f"not found: {path}"
        status = fs.getFileStatus(at)
        return (True, int(status.getLen()), "") if status.isFile() else (False, 0, f"not a file: {path}")
    except Exception as e:  # a store that cannot be reached
        return False, 0, f"cannot be read: {e}"


def memories_prose(memories: DataFrame) -> DataFrame:
    """(context): the memory, then a section for each project."""
    projects = F.transform(F.map_entries("project_memories"), lambda e: F.concat(F.lit("### Project "), F.substring(e["key"], 1, 8), F.lit("...\n\n"), e["value"]))
    head = F.when(F.size("project_memories") > 0, F.array(F.lit("\n---\n\n## Project-Specific Context\n"))).otherwise(F.array().cast("array<string>"))
    first = F.when(F.col("conversations_memory") != "", F.array("conversations_memory")).otherwise(F.array().cast("array<string>"))
    return memories.select(F.array_join(F.concat(first, head, projects), "\n\n").alias("context"))


def profile_prose(profile: DataFrame) -> DataFrame:
    part = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(f"## {title}\n\n"), c))
    return profile.select(F.concat_ws("\n\n", part("About the User", "user_profile"), part("User Preferences", "user_instructions")).alias("context"))


def trusted_context(memories: DataFrame, profile: DataFrame) -> DataFrame:
    """(context): memories where there are any, else the profile."""
    both = memories_prose(memories).withColumn("_at", F.lit(0)).unionByName(profile_prose(profile).withColumn("_at", F.lit(1)))
    return both.filter("context != ''").agg(F.min_by("context", "_at").alias("context"))
