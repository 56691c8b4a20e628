"""Operator 4 [native]: tool-call linking, with DataFrame and SQL functions only.

Calls and results are hash-joined by (conversation, call identifier); calls are put in topological order: after the
call whose result they used; arguments are checked against the tool's schema; every call is serialised as canonical
JSON (keys sorted, no blanks, numbers and strings as the variant type writes them).

Order: a call's level is its distance from a call without parent, by pointer doubling: after r rounds every call
knows its ancestor 2**r steps up, so a chain of n calls takes log2(n) joins of a small table. Calls on or behind a
cycle never reach the top; they have a null level and status "cycle". Inside a conversation calls are ordered by
(level, turn, call_id), by one sort within the conversation.

Cases: a second call with an identifier already used in its conversation keeps its row and has status "duplicate_id",
the first (by turn, then content) is linked; of several results for a call the first by turn is linked and n_results says how many
there were; a result without a call is kept as a row with status "orphan_result"; a call without a result is
"unanswered"; null identifiers never match; a parent that does not exist counts as none; arguments that are no
JSON object, null or empty ones included, are invalid with reason "not_an_object"; a tool without a schema gives
"unknown_tool"; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenweft.llm._common import stored

SCHEMA = "tool string, required array<string>, types map<string,string>, max_length map<string,int>, extra boolean"


def levels(calls: DataFrame, rounds: int = 40) -> DataFrame:
    """(conv_id, call_id, level) from calls(conv_id, call_id, parent_id), unique in (conv_id, call_id)."""
    known = calls.select("conv_id", F.col("call_id").alias("parent_id")).withColumn("real", F.lit(True))
    at = calls.join(known, ["conv_id", "parent_id"], "left").select("conv_id", "call_id", F.when(F.col("real"), F.col("parent_id")).alias("up"))
    at = at.withColumn("steps", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long"))
    left = None
    for _ in range(rounds):
        at = stored(at)
        still = at.where("up is not null").count()
        if not still or still == left:  # all at the top, or only cycles go on
            break
        left = still
        next_up = at.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"))
        at = at.join(next_up, ["conv_id", "up"], "left").select(
            "conv_id", "call_id", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
        )
    return at.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("steps")).alias("level"))


def reasons(arguments: Column, required: Column, types: Column, max_length: Column, extra: Column) -> Column:
    """Sorted array of what is wrong with the arguments (a variant, or null); empty if they are valid."""
    fields = F.try_variant_get(arguments, "$", "map<string,variant>")
    none = F.array().cast("array<string>")
    keys = F.map_keys(fields)
    missing = F.transform(F.array_except(F.coalesce(required, none), keys), lambda k: F.concat(F.lit("missing:"), k))
    declared = F.map_keys(types)
    unknown = F.when(F.coalesce(extra, F.lit(True)), none).otherwise(F.transform(F.array_except(keys, declared), lambda k: F.concat(F.lit("unexpected:"), k)))

    def kind(value: Column) -> Column:
        name = F.schema_of_variant(value)
        return F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "BIGINT", "integer").when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number").otherwise(F.lower(name))

    present = F.filter(F.coalesce(declared, none), lambda k: F.array_contains(keys, k))

    def wrong(k: Column) -> Column:
        found, wanted = kind(F.element_at(fields, k)), F.element_at(types, k)
        return (found != wanted) & ~((wanted == "number") & (found == "integer"))

    mistyped = F.transform(F.filter(present, wrong), lambda k: F.concat(F.lit("type:"), k))
    longest = F.filter(present, lambda k: F.length(F.try_variant_get(F.element_at(fields, k), "$", "string")) > F.element_at(max_length, k))
    long = F.transform(longest, lambda k: F.concat(F.lit("too_long:"), k))
    found = F.array_sort(F.concat(missing, unknown, mistyped, long))
    return F.when(fields.isNull(), F.array(F.lit("not_an_object"))).when(declared.isNull(), F.array(F.lit("unknown_tool"))).otherwise(found)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls: conv_id, turn, call_id, parent_id, tool, arguments (JSON text); results: conv_id, turn, call_id, content; schemas: SCHEMA.

    Gives conv_id, call_id, position, level, status, tool, valid, reasons, n_results, call_turn, result_turn, canonical.
    """
    w = Window.partitionBy("conv_id", "call_id").orderBy(F.col("turn").asc_nulls_last(), "tool", "arguments", "parent_id")
    numbered = stored(calls.select("conv_id", "turn", "call_id", "parent_id", "tool", "arguments").withColumn("again", F.row_number().over(w)))
    first = numbered.where("again = 1 and call_id is not null and conv_id is not null")
    by_level = levels(first.select("conv_id", "call_id", "parent_id"))
    got = results.select("conv_id", "call_id", F.struct(F.col("turn").isNull().alias("late"), "turn", "content").alias("r")).groupBy("conv_id", "call_id").agg(F.min("r").alias("r"), F.count(F.lit(1)).alias("n_results"))
    got = got.select("conv_id", "call_id", "n_results", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.lit(True).alias("answered"))
    # of calls with one identifier only the first takes part in the join
    key = F.when(F.col("again") == 1, F.col("call_id"))
    joined = numbered.withColumn("_key", key).join(
        got.select("conv_id", F.col("call_id").alias("_key"), "n_results", "result_turn", "content", "answered"), ["conv_id", "_key"], "full_outer",
    ).withColumn("orphan", F.col("again").isNull()).withColumn("call_id", F.coalesce("call_id", "_key"))
    placed = joined.join(by_level.withColumn("leveled", F.lit(True)), ["conv_id", "call_id"], "left").join(F.broadcast(schemas), "tool", "left")
    arguments = F.try_parse_json("arguments")
    status = (
        F.when(F.col("orphan"), "orphan_result").when(F.col("again") > 1, "duplicate_id").when(F.col("leveled") & F.col("level").isNull(), "cycle")
        .when(F.col("answered"), "linked").otherwise("unanswered")
    )
    level = F.when(F.col("again") == 1, F.col("level"))
    why = F.when(F.col("orphan"), F.array().cast("array<string>")).otherwise(reasons(arguments, F.col("required"), F.col("types"), F.col("max_length"), F.col("extra")))
    out = placed.withColumn("status", status).withColumn("level", level).withColumn("reasons", why)
    order = Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("call_id").asc_nulls_last(), "tool", "arguments")
    out = out.withColumn("position", F.row_number().over(order).cast("long")).withColumn("valid", F.when(~F.col("orphan"), F.size("reasons") == 0))
    canonical = F.to_json(F.struct(
        arguments.alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"), F.col("parent_id").alias("parent"), F.col("content").alias("result"),
    ), {"ignoreNullFields": "false"})
    return out.select("conv_id", "call_id", "position", "level", "status", "tool", "valid", F.array_join("reasons", ",").alias("reasons"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("turn").alias("call_turn"), "result_turn", canonical.alias("canonical"))


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as conversations hold them: a user turn asks the tool "reply", a system turn the tool "configure"; the
    assistant's turn right behind a turn is its result. A call's parent is the user call two turns before it, whose answer it follows.
    Every other role is a call of a tool named after it ("role:tool"; a null role gives a null tool), which has no schema. Only a row that
    is null in all four columns holds nothing and gives nothing."""
    rows = turns.select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    said = F.coalesce("text", F.lit(""))
    arguments = F.to_json(F.struct(F.length(said).alias("n_chars"), said.alias("prompt"), F.col("turn")))
    tool = F.when(F.col("role") == "user", "reply").when(F.col("role") == "system", "configure").otherwise(F.concat(F.lit("role:"), "role"))
    calls = rows.where("role != 'assistant' or role is null and (conv_id is not null or turn is not null or text is not null)").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.when(F.col("turn") >= 2, name(F.col("turn") - 2)).alias("parent_id"), tool.alias("tool"), arguments.alias("arguments"),
    )
    results = rows.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def conversation_schemas(spark: SparkSession) -> DataFrame:
    types = {"n_chars": "integer", "prompt": "string", "turn": "integer"}
    return spark.createDataFrame([("reply", ["prompt", "turn"], types, {"prompt": 400}, False), ("configure", ["prompt", "policy"], types | {"policy": "object"}, {"prompt": 300}, False)], SCHEMA)

