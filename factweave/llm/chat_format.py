"""Operator 8: chat formatting by event-sourced reconstruction (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Begins of the control strings; text that looks like one gets a backslash after its bracket.
_CONTROL = r"(/?s>|/?INST\]|/?TURN)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)(\\*){_CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)\\(\\*){_CONTROL}", r"$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log: conv_id, message, role, text.

    ``events``: conv_id, message (what orders and names a message), seq, kind,
    role, payload.  Kinds: delta adds its payload, edit replaces all text so far,
    regenerate starts anew, delete takes the message away until a later edit or
    regenerate.  Events count in the order of seq (ties: kind, payload).  Null payloads are
    empty; null kinds are deltas; the first role by order counts, null as empty.
    """
    event = F.struct("seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("payload", F.lit("")).alias("payload"), F.coalesce("role", F.lit("")).alias("role"))
    logs = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    numbered = logs.withColumn("log", F.transform("log", lambda e, i: F.struct(i.alias("i"), e["kind"].alias("kind"), e["payload"].alias("payload"), e["role"].alias("role"))))
    last = F.coalesce(F.array_max(F.transform(F.filter("log", lambda e: e["kind"] != "delta"), lambda e: e["i"])), F.lit(-1))
    counted = numbered.withColumn("last", last)
    kept = F.filter("log", lambda e: ((e["i"] > F.col("last")) & (e["kind"] == "delta")) | ((e["i"] == F.col("last")) & (e["kind"] == "edit")))
    gone = F.exists("log", lambda e: (e["i"] == F.col("last")) & (e["kind"] == "delete"))
    return counted.where(~gone).select("conv_id", "message", F.col("log")[0]["role"].alias("role"), F.array_join(F.transform(kept, lambda e: e["payload"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One formatted string for each conversation, with the spans to train on.

    Template: ``<s>``, then for each message in order ``[INST] text [/INST]``
    (user), `` text </s>`` (assistant) or ``[TURN role] text [/TURN]`` (any other
    role, URL-encoded).  Control strings inside texts are escaped reversibly.
    loss_spans has (start, length), from 1 and in code points, of each assistant
    text.  Columns: conv_id, formatted, loss_spans.

    The formatted string is one value, so a conversation is put together in one
    task; lengths and offsets are running sums, not folds over growing arrays.
    Roles and texts are not null here (``fold`` makes nulls empty); a null conv_id is a
    conversation of its own; very long texts and many turns make one long string; other
    columns are not looked at.
    """
    body = escape(F.col("text"))
    head = F.when(F.col("role") == "user", "[INST] ").when(F.col("role") == "assistant", " ").otherwise(F.concat(F.lit("[TURN "), F.url_encode("role"), F.lit("] ")))
    tail = F.when(F.col("role") == "user", " [/INST]").when(F.col("role") == "assistant", " </s>").otherwise(" [/TURN]")
    parts = messages.select("conv_id", "message", "role", head.alias("head"), body.alias("body"), tail.alias("tail"))
    size = F.length("head") + F.length("body") + F.length("tail")
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head") + 4)
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length")))
    row = F.struct("start", F.concat("head", "body", "tail").alias("piece"), span.alias("span"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    spans = F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull())
    return whole.select("conv_id", F.concat(F.lit("<s>"), F.array_join(F.transform("rows", lambda r: r["piece"]), "")).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted string: the inverse of ``render``."""
    pieces = F.filter(F.split(F.substring(formatted, 4, 2**31 - 1), r"(?<=\[/INST\]|</s>|\[/TURN\])"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.when(p.startswith("[INST] "), "user").when(p.startswith("[TURN "), F.url_decode(F.regexp_extract(p, r"^\[TURN ([^\]]*)\] ", 1))).otherwise("assistant")
        start = F.when(p.startswith("[INST] "), 8).when(p.startswith("[TURN "), F.length(F.regexp_extract(p, r"^(\[TURN [^\]]*\] )", 1)) + 1).otherwise(2)
        end = F.when(p.startswith("["), 8).otherwise(5)
        return F.struct(role.alias("role"), unescape(F.substring(p, start, F.length(p) - end - start + 1)).alias("text"))

    return F.transform(pieces, turn)


def chat_format(events: DataFrame) -> DataFrame:
    """Rebuild conversations from their event log and render them: see ``fold`` and ``render``.

    An empty log gives no rows; a conversation whose messages are all deleted
    gives none; repeated event rows are events of their own (deltas add twice).
    """
    return render(fold(events))


def table_events(rows: DataFrame) -> DataFrame:
    """The event log of a table of finished turns (conv_id, turn, role, text).

    Each row becomes what a live system would have logged for it: assistants
    stream a draft, regenerate and stream the text in two deltas; users type a
    part and then edit; others arrive whole.  Rows that repeat a turn are messages of
    their own, ordered by role and text.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    front, back = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    event = lambda i, kind, payload: F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("kind"), payload.alias("payload"))
    log = (
        F.when(F.col("role") == "assistant", F.array(event(0, "delta", front), event(1, "regenerate", F.lit("")), event(2, "delta", front), event(3, "delta", back)))
        .when(F.col("role") == "user", F.array(event(0, "delta", front), event(1, "edit", text)))
        .otherwise(F.array(event(0, "delta", text)))
    )
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    numbered = rows.select("conv_id", "turn", "role", "text", copy.alias("copy"))
    return numbered.select("conv_id", F.struct("turn", "copy").alias("message"), "role", F.explode(log).alias("e")).select("conv_id", "message", "e.seq", "e.kind", "role", "e.payload")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    made = chat_format(table_events(rows.union(extra)))
    turns = made.withColumn("turns", read_back(F.col("formatted")))
    script = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))), "")
    return turns.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(script, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op8_chat_format": op8_chat_format}
ORACLE_SQL = {
    "op8_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, length(regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\]|/?TURN)', '\1\\\2\3', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 16 + length(role) END))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
}
