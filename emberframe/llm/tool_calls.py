"""Tool calls in conversations: linked, ordered, checked and serialised.

Messages are calls, results or plain. A result names its call by identifier
within the conversation, a call may name one earlier call that it comes after.
Calls and results are hash-joined by identifier. A message then has at most one
message that must precede it, and pointer doubling finds for all of them at
once how many precede it and the latest turn among these: sorting by
(order_turn, depth, turn, key) is a topological order, also where a result stands
before its call. Arguments are checked against a schema per tool, and every
message becomes one line of canonical JSON: keys sorted, no spaces, no nulls.

Defined results: the first of several calls with one identifier (by turn) owns
it, the others are "repeated call"; a result without a call is "orphan", a call
without a result "unanswered"; a chain that leads back to itself, and all that
hangs on it, is "cyclic" and keeps its own turn; rows that agree in all fields are
one message, with their number in ``copies``; differing messages of one turn all
stay, in the order of the digests of their roles and texts; rows without
conversation or turn are passed on as "unplaced".
A null text is the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

#: Field types that a schema may name, and how the parsed value shows them.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}

Schemas = dict[str, dict[str, tuple[str, bool]]]


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """array<string> of what is wrong with a call's arguments; schemas: tool -> field -> (type, required)."""
    parsed = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    checks = F.when(~name.isin(*schemas) | name.isNull(), F.array(F.lit("unknown tool")))
    checks = checks.when(parsed.isNull() | ~is_object, F.array(F.lit("arguments are no object")))
    for tool, fields in sorted(schemas.items()):
        found: list[Column] = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            given = F.schema_of_variant(value)
            missing = value.isNull() | F.is_variant_null(value)
            wrong = ~given.startswith(TYPES[kind])
            said = F.when(missing, F.lit(f"{field} is missing" if required else None).cast("string"))
            found.append(said.when(wrong, F.lit(f"{field} is no {kind}")))
        extra = F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f) for f in sorted(fields)]))
        unknown = F.transform(F.array_sort(extra), lambda k: F.concat(k, F.lit(" is unknown")))
        checks = checks.when(name == tool, F.array_compact(F.concat(F.array(*found), unknown)))
    return checks


def canonical(json: Column) -> Column:
    """The value with keys sorted and no spaces; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(json))


def message_key(fields: list[str]) -> Column:
    """Half a digest of role and text, then half of one of all fields: 32 bytes that tell messages of one turn apart, and order them."""
    said = F.concat(F.coalesce("role", F.lit("")), F.lit("\x1f"), F.coalesce("content", F.lit("")))
    return F.unhex(F.concat(*[F.substring(F.sha2(x, 256), 1, 32) for x in (said, F.to_json(F.struct(*fields)))]))


def link(messages: DataFrame) -> DataFrame:
    """Adds ``parent`` (place of the message that must precede) and ``status``.

    messages: (conv, place, kind, call_id, after, ...), one row per conv and place;
    a place is (turn, key).
    """
    own = messages.filter("kind = 'call' AND call_id IS NOT NULL").groupBy("conv", "call_id").agg(F.min("place").alias("call_place"))
    answers = messages.filter("kind = 'result' AND call_id IS NOT NULL").groupBy("conv", "call_id").agg(F.min("place").alias("result_place"))
    owned = stored(own.join(answers, ["conv", "call_id"], "left"), "tool-calls")
    # Identifiers are unique in ``owned``, so its partitions make even hash tables.
    linked = messages.join(owned.hint("shuffle_hash"), ["conv", "call_id"], "left")
    before = owned.select("conv", F.col("call_id").alias("after"), F.coalesce("result_place", "call_place").alias("after_place"))
    linked = linked.join(before.hint("shuffle_hash"), ["conv", "after"], "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    first = F.col("place") == F.col("call_place")
    parent = F.when(is_result, F.col("call_place")).when(is_call & first, F.col("after_place"))
    status = (
        F.when(is_result & F.col("call_place").isNull(), "orphan")
        .when(is_result, "answer")
        .when(is_call & F.col("call_id").isNull(), "no identifier")
        .when(is_call & ~first, "repeated call")
        .when(is_call & F.col("result_place").isNull(), "unanswered")
        .when(is_call, "answered")
        .otherwise("plain")
    )
    return linked.withColumn("parent", parent).withColumn("status", status).drop("call_place", "result_place", "after_place")


def ordered(linked: DataFrame) -> DataFrame:
    """(conv, place, order_turn, depth, cyclic) of each message, by pointer doubling."""
    steps = F.col("parent").isNotNull().cast("int")
    now = stored(linked.select("conv", "place", F.col("parent").alias("at"), F.col("place.turn").alias("latest"), steps.alias("steps")), "tool-order")
    longest = now.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    # After k rounds a pointer is 2**k steps long; past the longest conversation only cycles are left.
    while reach <= 2 * longest and not now.filter("at IS NOT NULL").isEmpty():
        onward = now.select("conv", F.col("place").alias("at"), F.col("at").alias("next"), F.col("latest").alias("more"), F.col("steps").alias("further"))
        # Only messages that still point somewhere go on; those at their chain's start are targets alone.
        jumped = now.filter("at IS NOT NULL").join(onward, ["conv", "at"], "left")
        now = stored(
            jumped.select(
                "conv",
                "place",
                F.col("next").alias("at"),
                F.greatest("latest", "more").alias("latest"),
                (F.col("steps") + F.coalesce("further", F.lit(0))).alias("steps"),
            ).union(now.filter("at IS NULL").select("conv", "place", "at", "latest", "steps")),
            "tool-order",
        )
        reach *= 2
    cyclic = F.col("at").isNotNull()
    return now.select(
        "conv",
        "place",
        F.when(cyclic, F.col("place.turn")).otherwise(F.col("latest")).alias("order_turn"),
        F.when(cyclic, 0).otherwise(F.col("steps")).cast("long").alias("depth"),
        cyclic.alias("cyclic"),
    )


def format_messages(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv, turn, kind, call_id, status, order_turn, depth, errors, copies, json) of each message.

    messages: (conv, turn, kind, role, call_id, after, name, arguments, content);
    kind is call, result or message.
    """
    placed = messages.filter("conv IS NOT NULL AND turn IS NOT NULL")
    fields = ["kind", "role", "content", "call_id", "after", "name", "arguments"]
    # The key holds a digest of all fields, so rows with one key are copies of each other.
    keyed = placed.withColumn("place", F.struct("turn", message_key(fields).alias("key")))
    one = keyed.groupBy("conv", "place").agg(*[F.first(f).alias(f) for f in fields], F.count(F.lit(1)).alias("copies"))
    one = stored(one, "tool-messages")
    linked = stored(link(one.select("conv", "place", "kind", "call_id", "after")), "tool-links")
    placing = linked.select("conv", "place", "status").join(ordered(linked), ["conv", "place"])
    rows = one.join(placing, ["conv", "place"]).withColumn("turn", F.col("place.turn"))
    rows = rows.withColumn("status", F.when(F.col("cyclic"), "cyclic").otherwise(F.col("status"))).drop("cyclic", "place")
    loose = messages.filter("conv IS NULL OR turn IS NULL").select(
        "conv", "turn", F.lit(1).cast("long").alias("copies"), *fields, F.lit("unplaced").alias("status"), F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("depth")
    )
    both = rows.select(*loose.columns).union(loose)
    is_call = F.col("kind") == "call"
    errors = F.when(is_call, argument_errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array())
    called = F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("name"))
    json = F.to_json(
        F.struct(
            F.col("after"),
            F.when(is_call, called).alias("call"),
            F.col("call_id"),
            F.when(~is_call, F.coalesce("content", F.lit(""))).alias("content"),
            F.col("role"),
        )
    )
    return both.select("conv", "turn", "kind", "call_id", "status", "order_turn", "depth", F.array_join(errors, "; ").alias("errors"), "copies", json.alias("json"))


#: Tools of the registered query: what a user's turn asks for.
SCHEMAS: Schemas = {
    "ask": {"text": ("string", True), "words": ("integer", True)},
    "ask_long": {"text": ("string", True), "words": ("integer", True), "summary": ("string", True)},
}
#: From so many words on a request is long.
LONG = 60


def op4_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """A user's turn calls a tool, after the call of the turn before last; the assistant's next turn is its result."""
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.regexp_count(text, F.lit(r"\S+"))
    is_call, is_result = F.col("role") == "user", F.col("role") == "assistant"

    def named(turn: Column) -> Column:
        return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    messages = table.select(
        F.col("conv_id").alias("conv"),
        F.col("turn"),
        F.when(is_call, "call").when(is_result, "result").otherwise("message").alias("kind"),
        F.col("role"),
        text.alias("content"),
        F.when(is_call, named(F.col("turn"))).when(is_result, named(F.col("turn") - 1)).alias("call_id"),
        F.when(is_call & (F.col("turn") >= 2), named(F.col("turn") - 2)).alias("after"),
        F.when(is_call, F.when(number >= LONG, "ask_long").otherwise("ask")).alias("name"),
        F.when(is_call, F.to_json(F.struct(number.alias("words"), text.alias("text")))).alias("arguments"),
    )
    done = format_messages(messages, SCHEMAS)
    return done.withColumnsRenamed({"conv": "conv_id"})


OP4_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS content, count(*) AS copies,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         substr(sha256(coalesce(role, '') || chr(31) || coalesce(text, '')), 1, 32) AS k,
         CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS own
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), calls AS (
  SELECT conv_id, own, min(k) AS k FROM r WHERE kind = 'call' GROUP BY ALL
), answers AS (
  SELECT conv_id, own, min(k) AS k FROM r WHERE kind = 'result' GROUP BY ALL
), g AS (
  SELECT r.*, c.k AS call_k, a.k AS answer_k,
         CASE WHEN r.kind = 'result' AND c.k IS NOT NULL THEN r.turn - 1
              WHEN r.kind = 'call' AND r.k = c.k AND b.k IS NOT NULL THEN CASE WHEN ba.k IS NOT NULL THEN r.turn - 1 ELSE r.turn - 2 END END AS parent,
         CASE WHEN r.kind = 'result' THEN c.k WHEN r.kind = 'call' THEN coalesce(ba.k, b.k) END AS parent_k
  FROM r LEFT JOIN calls c ON c.conv_id = r.conv_id AND c.own = r.own
         LEFT JOIN answers a ON a.conv_id = r.conv_id AND a.own = r.own
         LEFT JOIN calls b ON r.kind = 'call' AND b.conv_id = r.conv_id AND b.own = r.turn - 2
         LEFT JOIN answers ba ON r.kind = 'call' AND ba.conv_id = r.conv_id AND ba.own = r.turn - 2
), d AS (
  SELECT conv_id, turn, k, 0::BIGINT AS depth FROM g WHERE parent IS NULL
  UNION ALL
  SELECT g.conv_id, g.turn, g.k, d.depth + 1 FROM g JOIN d ON g.conv_id = d.conv_id AND g.parent = d.turn AND g.parent_k = d.k
), w AS (
  SELECT g.*, depth, len(regexp_extract_all(content, '\S+')) AS words,
         'c' || conv_id || '-' || own AS call_id, CASE WHEN kind = 'call' AND turn >= 2 THEN 'c' || conv_id || '-' || (turn - 2) END AS after_id
  FROM g JOIN d USING (conv_id, turn, k)
)
SELECT conv_id, turn, kind, call_id,
       CASE WHEN kind = 'result' THEN CASE WHEN call_k IS NULL THEN 'orphan' ELSE 'answer' END
            WHEN kind = 'call' THEN CASE WHEN k <> call_k THEN 'repeated call' WHEN answer_k IS NULL THEN 'unanswered' ELSE 'answered' END ELSE 'plain' END AS status,
       turn AS order_turn, depth,
       CASE WHEN kind = 'call' AND words >= {LONG} THEN 'summary is missing' ELSE '' END AS errors, copies,
       '{{' || concat_ws(',', '"after":"' || after_id || '"',
         CASE WHEN kind = 'call' THEN '"call":{{"arguments":{{"text":' || to_json(content)::VARCHAR || ',"words":' || words || '}},"name":"'
              || CASE WHEN words >= {LONG} THEN 'ask_long' ELSE 'ask' END || '"}}' END,
         '"call_id":"' || call_id || '"', CASE WHEN kind <> 'call' THEN '"content":' || to_json(content)::VARCHAR END,
         '"role":' || to_json(role)::VARCHAR) || '}}' AS json
FROM w
"""
