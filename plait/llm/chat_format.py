"""Chat formatting: tool calls linked to their results, checked, ordered and written as canonical JSON.

Only DataFrame operations. Results are hash-joined to calls on (conversation, identifier); each result thereby
depends on the message that made the call, which may itself be a result. These dependencies form a forest, whose
depths and roots are found by pointer doubling; (root turn, depth, turn) is a topological order that leaves everything else
where it was. Arguments are parsed as variants, whose text has sorted keys and no spare white space, and checked
against the schemas of the tools. No conversation is ever gathered: every message is a row with its own order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.llm.common import settle

CALLS = "array<struct<id: string, name: string, arguments: string>>"
#: Names of JSON types as a variant has them.
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def _errors(call: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """What is wrong with a call, as a sorted, comma-separated text; empty if nothing is."""
    given = F.try_parse_json(call["arguments"])
    found: list[Column] = [F.when(given.isNull() | ~F.schema_of_variant(given).startswith("OBJECT"), F.lit("arguments: not an object"))]
    for tool, fields in sorted(schemas.items()):
        mine = call["name"].eqNullSafe(tool)
        for field, rule in sorted(fields.items()):
            value = F.try_variant_get(given, f"$.{field}", "variant")
            absent = value.isNull() | F.is_variant_null(value)
            if rule.get("required"):
                found.append(F.when(mine & absent, F.lit(f"{field}: missing")))
            kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
            found.append(F.when(mine & ~absent & ~kind.isin(_TYPES[rule["type"]]), F.lit(f"{field}: not of type {rule['type']}")))
            length = F.length(F.try_variant_get(given, f"$.{field}", "string"))
            if "maxLength" in rule:
                found.append(F.when(mine & (length > rule["maxLength"]), F.lit(f"{field}: too long")))
            if "minLength" in rule:
                found.append(F.when(mine & (length < rule["minLength"]), F.lit(f"{field}: too short")))
    known = call["name"].isin(list(schemas)) & call["name"].isNotNull() if schemas else F.lit(False)
    found.append(F.when(~F.coalesce(known, F.lit(False)), F.lit("name: unknown tool")))
    return F.array_join(F.array_compact(F.array(*found)), ", ")


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(text))
    return array.substr(F.lit(2), F.length(array) - 2)


def _call_json(call: Column) -> Column:
    arguments = F.coalesce(F.to_json(F.try_parse_json(call["arguments"])), _quoted(call["arguments"]))
    return F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), _quoted(call["id"]), F.lit(',"name":'), _quoted(call["name"]), F.lit("}"))


def _forest(parents: DataFrame) -> DataFrame:
    """For (conv, node, parent) with one parent a node: conv, node, root and depth; nodes on or above a cycle are left out."""
    state = settle(parents.select("conv", "node", F.col("parent").alias("at"), F.lit(1).cast("bigint").alias("depth")))
    for _ in range(state.count().bit_length() + 1):  # a root is at most as many steps away as there are nodes
        up = state.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("at").alias("further"), F.col("depth").alias("more"))
        joined = state.join(up, F.expr("conv <=> c and at <=> n"), "left").withColumn("moved", F.col("c").isNotNull() | F.col("n").isNotNull())
        if joined.where("moved").limit(1).count() == 0:
            break
        state = settle(joined.select("conv", "node", F.when(F.col("moved"), F.col("further")).otherwise(F.col("at")).alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    over = state.select(F.col("conv").alias("c"), F.col("node").alias("n"))
    return state.join(over, F.expr("conv <=> c and at <=> n"), "left_anti").select("conv", "node", F.col("at").alias("root"), "depth")


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """Messages (conv_id, turn, role, text, calls, result_of) with their links, checks, order and canonical JSON.

    calls: array of (id, name, arguments as JSON text); result_of: the identifier of the call that a message answers.
    Returns one row per message: conv_id, turn, role, call_turn (of the answered call; null if the message is no
    result, or an orphan), n_calls, n_answered, errors, order_turn and depth (sort by order_turn, depth, turn), message.

    Of calls that repeat an identifier in a conversation the one of the smallest turn counts; several results may answer
    one call. A result that would depend on itself is an orphan. A null identifier links nothing; null conversations
    and turns are values like any other; a null text is null in the JSON; null calls are none. Arguments that are
    no JSON object stay as text. Repeated rows each give a row. An empty table gives an empty result.
    """
    rows = messages.select("conv_id", "turn", "role", "text", F.coalesce(F.col("calls").cast(CALLS), F.array().cast(CALLS)).alias("calls"), "result_of")
    made = rows.select("conv_id", "turn", F.explode("calls").alias("call")).select(F.col("conv_id").alias("call_conv"), F.col("call.id").alias("call_id"), "turn").where("call_id is not null")
    calls = made.groupBy("call_conv", "call_id").agg(F.min("turn").alias("call_turn"))
    # The hash join on (conversation, identifier). Both sides are shuffled for it, so a hot identifier can be split.
    linked = rows.join(calls, F.expr("conv_id <=> call_conv and result_of = call_id"), "left").withColumn("is_linked", F.col("call_id").isNotNull()).drop("call_conv", "call_id")
    answers = rows.where("result_of is not null").select(F.col("conv_id").alias("a_conv"), F.col("result_of").alias("a_id")).distinct()
    answered = (
        made.join(answers, F.expr("call_conv <=> a_conv and call_id = a_id"), "left_semi").groupBy(F.col("call_conv").alias("n_conv"), F.col("turn").alias("n_turn"))
        .agg(F.countDistinct("call_id").alias("n_answered"))
    )
    parents = linked.where("is_linked").groupBy(F.col("conv_id").alias("conv"), F.col("turn").alias("node")).agg(F.min("call_turn").alias("parent"))
    forest = settle(_forest(parents))
    tree = linked.join(forest, F.expr("is_linked and conv_id <=> conv and turn <=> node"), "left").join(answered, F.expr("size(calls) > 0 and conv_id <=> n_conv and turn <=> n_turn"), "left")
    inside = F.col("is_linked") & F.col("depth").isNotNull()
    errors = F.array_join(F.filter(F.transform("calls", lambda c: _errors(c, schemas)), lambda e: e != ""), "; ")
    message_calls = F.transform("calls", _call_json)
    message = F.concat(
        F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"role":'), _quoted(F.col("role")),
        F.when(inside, F.concat(F.lit(',"tool_call_id":'), _quoted(F.col("result_of")))).otherwise(F.lit("")),
        F.when(F.size("calls") > 0, F.concat(F.lit(',"tool_calls":['), F.array_join(message_calls, ","), F.lit("]"))).otherwise(F.lit("")),
        F.lit("}"),
    )
    return tree.select(
        "conv_id",
        "turn",
        "role",
        F.when(inside, F.col("call_turn")).alias("call_turn"),
        F.size("calls").cast("bigint").alias("n_calls"),
        F.coalesce("n_answered", F.lit(0)).cast("bigint").alias("n_answered"),
        errors.alias("errors"),
        F.when(inside, F.col("root")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(inside, F.col("depth")).otherwise(F.lit(0)).cast("bigint").alias("depth"),
        message.alias("message"),
    )


#: The tool behind a conversation: a user's turn asks for a reply, the turn after it gives one.
REPLY = {"reply": {"prompt": {"type": "string", "required": True, "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "required": True}}}


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations as messages: each user turn calls `reply`, and an assistant turn answers the turn before it."""
    call = F.struct(
        F.concat_ws(":", F.lit("call"), F.col("turn").cast("string")).alias("id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"))).alias("arguments"),
    )
    return conversations.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("role") != "user", F.col("text")).alias("text"),
        F.when(F.col("role") == "user", F.array(call)).alias("calls"),
        F.when(F.col("role") == "assistant", F.concat_ws(":", F.lit("call"), (F.col("turn") - 1).cast("string"))).alias("result_of"),
    )

