"""Chat formatting: tool calls joined to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import written


def parsed_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, nth, role, text and, where the text is such JSON, the calls it makes or the call it answers.

    ``nth`` numbers the messages of one turn, by role and text, so that (turn, nth) names one message.

    An assistant message makes calls with ``{"tool_calls": [{"id", "name", "arguments"}]}``; a tool message answers
    with ``{"tool_call_id", "content"}``. Any other text is plain.
    """
    nth = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    body = F.try_parse_json(F.when(F.col("role").isin("assistant", "tool"), F.col("text")))
    got = messages.select("conv_id", "turn", nth.alias("nth"), "role", "text", body.alias("_body"))
    calls = F.try_variant_get("_body", "$.tool_calls", "array<variant>")
    return got.select(
        "conv_id", "turn", "nth", "role", "text",
        F.when((F.col("role") == "assistant") & (F.size(calls) > 0), calls).alias("calls"),
        F.when(F.col("role") == "tool", F.try_variant_get("_body", "$.tool_call_id", "string")).alias("answers"),
        F.try_variant_get("_body", "$.content", "variant").alias("content"),
    )


def calls_of(parsed: DataFrame) -> DataFrame:
    """One row per call: id, tool, arguments (text that holds JSON is parsed) and the call it comes after."""
    rows = parsed.filter("calls is not null").select("conv_id", "turn", "nth", F.posexplode("calls").alias("pos", "call"))
    rows = rows.select(
        "conv_id", "turn", "nth", "pos", F.try_variant_get("call", "$.id", "string").alias("call_id"),
        F.try_variant_get("call", "$.name", "string").alias("tool"),
        F.coalesce(F.try_parse_json(F.try_variant_get("call", "$.arguments", "string")), F.try_variant_get("call", "$.arguments", "variant")).alias("arguments"),
    )
    first = rows.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "nth", "pos")).alias("first"))
    rows = rows.join(first, ["conv_id", "call_id"], "left")
    return rows.select(
        "conv_id", "turn", "nth", "pos", "call_id", "tool", "arguments",
        F.try_variant_get("arguments", "$.after", "string").alias("after"),
        F.coalesce(
            F.col("first.turn").eqNullSafe(F.col("turn")) & (F.col("first.nth") == F.col("nth")) & (F.col("first.pos") == F.col("pos")), F.lit(False)
        ).alias("own_id"),
    )


def ordered_calls(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, latest, cyclic) of identified calls, by doubling the step to earlier calls.

    ``depth`` counts the calls that come before along ``after``, ``latest`` is the greatest turn among them and the
    call itself. Rounds grow with the logarithm of the longest chain; what no round can finish is a cycle, or hangs
    on one.
    """
    nodes = calls.filter("own_id").select("conv_id", "call_id", "turn", "after")
    known = nodes.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    state = nodes.join(known, ["conv_id", "after"], "left").select(
        "conv_id", "call_id", F.when(F.col("there"), F.col("after")).alias("up"),
        F.when(F.col("there"), 1).otherwise(0).alias("depth"), F.col("turn").alias("latest"),
    )
    state, open_before = written(state, "order"), None
    while True:
        still = state.filter("up is not null").count()
        if not still or still == open_before:
            break
        open_before = still
        jump = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("latest").alias("latest2"))
        state = written(state.join(jump, ["conv_id", "up"], "left").select(
            "conv_id", "call_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            F.greatest("latest", "latest2").alias("latest"),
        ), "order")
    return state.select("conv_id", "call_id", "depth", "latest", F.col("up").isNotNull().alias("cyclic"))


def _kind(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return (
        F.when(name == "BIGINT", "integer").when(name.startswith("DECIMAL") | (name == "DOUBLE"), "number")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise(F.lower(name))
    )


def violations(arguments: Column, properties: Column) -> Column:
    """Codes of what the arguments break: ``properties`` maps a name to its type and whether it is required."""
    given = F.try_variant_get(arguments, "$", "map<string,variant>")
    names, allowed = F.map_keys(given), F.map_keys(properties)
    missing = F.filter(allowed, lambda k: properties[k]["required"] & ~F.array_contains(names, k))
    unknown = F.array_except(names, allowed)
    kind = lambda k: _kind(given[k])
    wrong = F.filter(
        F.array_intersect(names, allowed),
        lambda k: (kind(k) != properties[k]["type"]) & ~((kind(k) == "integer") & (properties[k]["type"] == "number"))
        & ~((kind(k) == "null") & ~properties[k]["required"]),
    )
    code = lambda xs, what: F.transform(xs, lambda k: F.concat(F.lit(f"{what}:"), k))
    return (
        F.when(properties.isNull(), F.array(F.lit("unknown_tool"))).when(given.isNull(), F.array(F.lit("not_an_object")))
        .otherwise(F.array_sort(F.concat(code(missing, "missing"), code(unknown, "unknown"), code(wrong, "type"))))
    )


def tool_schemas(schemas: DataFrame) -> DataFrame:
    """One row per tool from rows (tool, name, type, required); the first of repeated names counts."""
    one = schemas.groupBy("tool", "name").agg(F.min(F.struct("type", "required")).alias("p"))
    return one.groupBy("tool").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "p")))).alias("properties"))


def format_chats(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per conversation: canonical JSON of its messages and tool calls, and counts of what was found.

    Calls are joined to results by conversation and identifier. Messages stand in the order of their turns; a call
    with an argument ``after`` never stands before the call that it names, and a result stands with its call. JSON
    is canonical: keys sorted, no blanks, one spelling of numbers. Per conversation: ``n_messages``, ``n_calls``,
    ``n_linked``, ``n_orphans`` (results without call), ``n_invalid`` (calls with violations) and ``chat``.

    A call without identifier, or with one that an earlier call has, links to nothing (``repeated_id``); of several
    results the earliest counts and the others are orphans. Orphans stand at their turns as messages with
    ``"orphan":true``, the content of a message that makes calls before its calls. A call that comes after itself is
    flagged ``cycle`` and keeps its turn. Messages of one turn stand in the order of role and text. Null and empty
    texts are plain messages, null roles too, and so is an empty list of calls; JSON that cannot be read, or repeats
    a key, is plain text. Identifiers of conversations may have any type that casts to text; rows without one belong to one
    conversation, null. Repeated messages are repeated in the chat, a repeated call as one with a repeated identifier. Only conv_id, turn, role and text are read; an empty table gives no rows.
    """
    named = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("name"))
    kept = messages.select(named.alias("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    rows = written(parsed_messages(kept), "messages")
    calls = calls_of(rows)
    order = ordered_calls(calls)
    answers = rows.filter("answers is not null").withColumnRenamed("answers", "call_id")
    at = F.struct("turn", "nth")
    results = answers.groupBy("conv_id", "call_id").agg(F.min_by("content", at).alias("result"), F.min(at).alias("first"), F.count("*").alias("n_results"))
    linked = calls.join(order, ["conv_id", "call_id"], "left").join(results, ["conv_id", "call_id"], "left")
    linked = linked.join(tool_schemas(schemas), "tool", "left")
    own = F.col("own_id")
    faults = F.concat(
        violations(F.col("arguments"), F.col("properties")),
        F.when(own, F.array().cast("array<string>")).otherwise(F.array(F.lit("repeated_id"))),
        F.when(own & F.coalesce("cyclic", F.lit(False)), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
    )
    placed = own & ~F.coalesce("cyclic", F.lit(False))
    is_linked = own & F.col("n_results").isNotNull()
    call_items = linked.withColumn("faults", faults).select(
        "conv_id",
        F.struct(
            F.when(placed, F.col("latest")).otherwise(F.col("turn")).alias("a"), F.when(placed, F.col("depth")).otherwise(0).alias("b"),
            F.col("turn").alias("c"), F.col("nth").alias("e"), F.col("pos").alias("d"),
            F.to_json(F.struct(
                "arguments", F.col("call_id").alias("id"), F.col("tool").alias("name"),
                F.when(is_linked, F.col("result")).alias("result"), F.when(F.size("faults") > 0, F.col("faults")).alias("violations"),
            )).alias("json"),
        ).alias("item"),
        F.lit(1).alias("calls"), is_linked.cast("int").alias("linked"), F.lit(0).alias("orphans"), (F.size("faults") > 0).cast("int").alias("invalid"),
    )
    def messages_of(some: DataFrame, body: Column, orphans: int) -> DataFrame:
        item = F.struct(
            F.col("turn").alias("a"), F.lit(-1).alias("b"), F.col("turn").alias("c"), F.col("nth").alias("e"), F.lit(0).alias("d"),
            F.to_json(body).alias("json"),
        )
        return some.select("conv_id", item.alias("item"), F.lit(0).alias("calls"), F.lit(0).alias("linked"), F.lit(orphans).alias("orphans"), F.lit(0).alias("invalid"))

    plain = messages_of(rows.filter("calls is null and answers is null"), F.struct(F.coalesce("text", F.lit("")).alias("content"), "role"), 0)
    said = messages_of(rows.filter("calls is not null and content is not null"), F.struct("content", "role"), 0)
    used = results.join(calls.filter("own_id").select("conv_id", "call_id"), ["conv_id", "call_id"]).select("conv_id", "call_id", "first")
    left = answers.join(used, ["conv_id", "call_id"], "left").filter(
        F.col("first").isNull() | ~(F.col("first.turn").eqNullSafe(F.col("turn")) & (F.col("first.nth") == F.col("nth")))
    )
    orphans = messages_of(left, F.struct("content", F.lit(True).alias("orphan"), "role", F.col("call_id").alias("tool_call_id")), 1)
    totals = rows.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    chats = call_items.unionByName(plain).unionByName(said).unionByName(orphans).groupBy("conv_id").agg(
        F.sum("calls").alias("n_calls"), F.sum("linked").alias("n_linked"), F.sum("orphans").alias("n_orphans"),
        F.sum("invalid").alias("n_invalid"), F.array_sort(F.collect_list("item")).alias("items"),
    )
    out = totals.join(chats, "conv_id")
    ident = F.when(~F.col("conv_id.none"), F.col("conv_id.name")).cast(messages.schema["conv_id"].dataType)
    body = F.concat(F.lit('{"messages":['), F.array_join(F.transform("items", lambda x: x["json"]), ","), F.lit("]}"))
    return out.select(
        ident.alias("conv_id"), "n_messages", *[F.col(c).cast("bigint").alias(c) for c in ("n_calls", "n_linked", "n_orphans", "n_invalid")], body.alias("chat")
    )


# What the tools of the derived calls take.
SCHEMAS = [
    ("answer", "question", "string", True), ("answer", "turn", "integer", True), ("answer", "after", "string", False),
    ("search", "query", "string", True), ("search", "limit", "integer", False),
]


def calls_from_turns(conversations: DataFrame) -> DataFrame:
    """Tool messages made of plain turns: a user turn becomes a call, the assistant turn after it its result.

    The call of a user turn is ``answer``, or for every third turn number ``search``, with an argument that its schema does not
    have; it comes after the call of two turns before. Other roles stay plain.
    """
    name = lambda turn: F.concat(F.lit("c"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("-"), turn.cast("string"))
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    after = F.when(turn >= 2, name(turn - 2))
    call = F.when(turn % 3 == 2, F.to_json(F.struct(F.array(F.struct(
        name(turn).alias("id"), F.lit("search").alias("name"), F.struct(text.alias("query"), turn.alias("page"), after.alias("after")).alias("arguments"),
    )).alias("tool_calls")))).otherwise(F.to_json(F.struct(F.array(F.struct(
        name(turn).alias("id"), F.lit("answer").alias("name"), F.struct(text.alias("question"), turn.alias("turn"), after.alias("after")).alias("arguments"),
    )).alias("tool_calls"))))
    result = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), text.alias("content")))
    return conversations.select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"),
    )
