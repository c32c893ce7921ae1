"""Chat formatting from event logs.

``fold`` rebuilds final messages from the log of a conversation. Events have a conversation, a message, a sequence
that orders the events of the conversation, a kind, a role and a text:

- ``open`` starts the message with its role and a first text; ``delta`` appends its text;
- ``edit`` replaces the text so far; ``regenerate`` empties the message and withdraws all later messages opened before
  it. Text of later deltas is appended again.

Only what follows a message's last ``open``, ``edit`` or ``regenerate`` counts. Messages stand in the order of
``message``, any sortable columns. Deltas of a message that was never opened give a message without role.

``render`` writes one string per conversation and marks the assistant's text in a loss mask; ``parse`` reads both
back. Control strings in roles and texts are escaped, so every text comes back as it was.

Null role or text: empty. A null conversation is one conversation. Repeated events of equal sequence are applied each
(ordered by kind and text); an event of an unknown kind is ignored. No events: no conversation. Everything is built-in
functions; a message is folded by itself, so a long conversation is spread until its one string is put together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, ROLE_END, END = "### ", ": ", "</turn>\n"
#: Replaced in this order, and back in the opposite order.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, rules: Sequence[tuple[str, str]] = ESCAPES) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, text)


def unescape(text: Column, rules: Sequence[tuple[str, str]] = ESCAPES) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[1]), F.lit(r[0])), rules[::-1], text)


def fold(
    events: DataFrame, conversation: str = "conv_id", message: Sequence[str] = ("message",), sequence: str = "seq",
) -> DataFrame:
    """``conversation``, the ``message`` columns, ``role`` and ``text`` of every message that stands at the end."""
    keys = [conversation, *message]
    text = F.coalesce("text", F.lit(""))
    rows = events.select(*keys, F.col(sequence).alias("seq"), "kind", "role", text.alias("text"))
    rows = rows.filter(F.col("kind").isin("open", "delta", "edit", "regenerate"))
    resets = F.col("kind") != "delta"
    said = F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text"))
    each = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("seq", resets.alias("resets"), said.alias("text")))).alias("log"),
        F.max_by("role", F.when(F.col("kind") == "open", F.col("seq"))).alias("role"),
        F.max(F.when(F.col("kind") == "open", F.col("seq"))).alias("opened"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
    )
    begin = F.greatest(F.array_position(F.reverse(F.col("log.resets")), True), F.lit(0))
    texts = F.col("log.text")
    tail = F.when(begin > 0, F.slice(texts, F.size(texts) - begin.cast("int") + 1, begin.cast("int"))).otherwise(texts)
    before = Window.partitionBy(conversation).orderBy(*message).rowsBetween(Window.unboundedPreceding, -1)
    folded = each.select(*keys, "role", F.array_join(tail, "").alias("text"), "opened", "again")
    cut = folded.filter(F.col("again").isNotNull()).select(F.col(conversation).alias("__c")).distinct()
    touched = F.col(conversation).eqNullSafe(F.col("__c"))
    checked = folded.join(cut, touched, "left_semi").withColumn("last", F.max("again").over(before))
    kept = checked.filter(F.col("last").isNull() | (F.col("opened") > F.col("last"))).drop("last")
    return folded.join(cut, touched, "left_anti").unionByName(kept).select(*keys, "role", "text")


def render(
    messages: DataFrame, conversation: str = "conv_id", message: Sequence[str] = ("message",), learn: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``formatted`` and ``mask``, per turn the offset and length (code points, 0 when it is
    not learnt) of the learnt text inside the turn's block."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD), escape(role, ROLE_ESCAPES), F.lit(ROLE_END))
    body = escape(text)
    turn = F.struct(
        *message, F.concat(head, body, F.lit(END)).alias("block"),
        F.struct(F.length(head).alias("at"), F.when(role == learn, F.length(body)).otherwise(0).alias("n")).alias("mask"),
    )
    turns = messages.groupBy(conversation).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return turns.select(conversation, F.array_join("turns.block", "").alias("formatted"), F.col("turns.mask").alias("mask"))


def parse(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """``turns`` (role, text) and ``learnt`` (texts under the mask) read back from ``formatted`` and ``mask``."""
    parts = F.split("formatted", f"\\Q{END}\\E", -1)
    blocks = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(block: Column) -> Column:
        colon = F.instr(block, ROLE_END)
        role = F.substr(block, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)
        return F.struct(
            unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substr(block, colon + len(ROLE_END))).alias("text")
        )

    learnt = F.zip_with(blocks, F.col("mask"), lambda b, m: unescape(F.substr(b, m["at"] + 1, m["n"])))
    return formatted.select(conversation, "formatted", F.transform(blocks, turn).alias("turns"), learnt.alias("learnt"))


def events_of(turns: DataFrame, chunk: int = 64) -> DataFrame:
    """A streamed event log of finished turns (``conv_id``, ``turn``, ``role``, ``text``): each turn is opened with its
    role, then grows by deltas of ``chunk`` code points. Turns of equal number are told apart by ``copy``."""
    text = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id", "turn").orderBy("role", text)
    rows = turns.withColumn("copy", F.row_number().over(order))
    steps = F.sequence(F.lit(0), F.ceil(F.length(text) / chunk).cast("int"))
    event = rows.select("conv_id", "turn", "copy", "role", text.alias("text"), F.explode(steps).alias("step"))
    return event.select(
        "conv_id", "turn", "copy", F.struct("turn", "copy", "step").alias("seq"),
        F.when(F.col("step") == 0, "open").otherwise("delta").alias("kind"), "role",
        F.when(F.col("step") == 0, "").otherwise(F.substr("text", (F.col("step") - 1) * chunk + 1, F.lit(chunk))).alias("text"),
    )


#: The digests of the registered query in SQL, over a table ``conversations``.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c') AS head FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
