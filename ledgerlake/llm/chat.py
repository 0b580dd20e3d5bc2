"""Chat formatting by event-sourced reconstruction. DataFrame functions only.

A log has one row per event: `message` opens a message with its role and text, `delta` adds text, `edit` puts its
text in place of all so far, `regenerate` empties the text for what follows. Events carry the number of their
message in the conversation. They are brought together per (conversation, message), folded in the order of seq,
and the final messages are joined per conversation and rendered.

Template: <|turn|>role<|text|>text<|end|> per message. In roles and texts a backslash is doubled and "<|" becomes
"<\\|", so no control string can occur inside, and reading back takes each backslash with the character after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Kinds of events that put an end to the text before them.
RESETS = ("message", "edit", "regenerate")
MESSAGES = "array<struct<role:string,text:string>>"
SEGMENTS = "array<struct<text:string,loss:boolean>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, message, messages) of events(conv_id, message, seq, event, role, text): final messages of a number.

    Nulls: a null text is empty, a null role is empty, a null seq sorts first, null ids are ids of their own, and a
    null event is a message. Events of equal seq go by event, role and text. Several `message` events of one number
    each open a message of their own, in that order; the other events belong to the last one opened. Events before
    any opener make a message without role. A conversation's events of one message are one task's work, as is the
    text they become.
    """
    event = F.coalesce("event", F.lit("message"))
    one = F.struct(
        F.col("seq").cast("bigint").alias("seq"), event.alias("event"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = events.select("conv_id", "message", one.alias("e")).groupBy("conv_id", "message")
    log = rows.agg(F.array_sort(F.collect_list("e")).alias("log"))
    opens = F.transform(F.filter(F.transform("log", lambda e, k: F.struct((e["event"] == "message").alias("open"), k.alias("k"))), lambda x: x["open"] | (x["k"] == 0)), lambda x: x["k"])
    log = log.select("conv_id", "message", "log", opens.alias("opens"))
    ends = lambda k: F.coalesce(F.get(F.col("opens"), k + 1), F.size("log"))
    runs = log.select("conv_id", "message", F.transform("opens", lambda at, k: F.slice("log", at + 1, ends(k) - at)).alias("runs"))
    messages = F.transform("runs", lambda run: F.struct(run[0]["role"].alias("role"), _final_text(run).alias("text")))
    return runs.select("conv_id", "message", messages.cast(MESSAGES).alias("messages"))


def _final_text(run: Column) -> Column:
    """Texts from the last reset on, joined."""
    resets = F.transform(run, lambda e, k: F.when(e["event"].isin(*RESETS), k).otherwise(F.lit(0)))
    kept = F.slice(run, F.array_max(resets) + 1, F.size(run))
    return F.array_join(F.transform(kept, lambda e: F.when(e["event"] == "regenerate", F.lit("")).otherwise(e["text"])), "")


def conversations(events: DataFrame) -> DataFrame:
    """(conv_id, messages): all final messages of each conversation in the order of their numbers."""
    found = folded(events).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "messages"))).alias("all"))
    return found.select("conv_id", F.flatten(F.transform("all", lambda x: x["messages"])).alias("messages"))


def segments(messages: Column) -> Column:
    """The rendered conversation as (text, loss) in order; loss marks what the assistant said and nothing else."""

    def of(m: Column) -> Column:
        head = F.concat(F.lit(TURN), escaped(m["role"]), F.lit(TEXT))
        said = F.struct(escaped(m["text"]).alias("text"), (m["role"] == "assistant").alias("loss"))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")), said, F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))).cast(SEGMENTS)

    return F.flatten(F.transform(messages, of))


def rendered(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments): the text to train on, and the same text cut by the loss mask."""
    found = conversations(events).select("conv_id", segments(F.col("messages")).alias("segments"))
    return found.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """Messages of a formatted text."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: t != "")

    def of(turn: Column) -> Column:
        return F.struct(
            unescaped(F.substring_index(F.substring(turn, len(TURN) + 1, F.length(turn)), TEXT, 1)).alias("role"),
            unescaped(F.substring(turn, F.instr(turn, TEXT) + len(TEXT), F.length(turn))).alias("text"),
        )

    return F.transform(turns, of)


def row_events(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as one opening event each."""
    turn = F.col("turn").cast("bigint")
    return rows.select(F.col("conv_id").cast("bigint"), turn.alias("message"), turn.alias("seq"), F.lit("message").alias("event"), "role", "text")


def op8_chat(rows: DataFrame) -> DataFrame:
    """The contract's columns, read back from the output; conversation -7 is added to the rows."""
    tricky = "</s>[INST] ok [/INST]"
    own = rows.sparkSession.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    found = rendered(row_events(rows.select("conv_id", "turn", "role", "text").unionByName(own)))
    turns, lost = read_back(F.col("formatted")), F.filter("segments", lambda s: s["loss"])
    found = found.select(
        "conv_id", turns.alias("turns"), F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.array_join(F.transform(lost, lambda s: unescaped(s["text"])), "").alias("loss"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


#: Columns that follow from the rows alone; formatted_chars adds the template's marks and what escaping adds.
ORACLE = """
WITH all_rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), told AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(23 + length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|')) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))) AS chars
    FROM all_rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(chars AS BIGINT) AS formatted_chars
FROM told
"""
