"""Chat formatting by event sourcing, in DataFrame operations alone.

A log has conv_id, message (orders the messages of a conversation), seq (orders its events), kind, role and text:

- message: sets role and text of a message
- delta: adds text to its end
- edit: replaces its text
- regenerate: empties its text, and drops every later message of the conversation as far as it was logged before

Null text is empty, a null role is empty, a null kind is a message. Events with equal seq go by kind, role and text, so
repeated rows have a defined result. A null conv_id is a conversation of its own. An empty log gives no rows. Texts of any
length are folded whole. A conversation is one row of the result, so one task folds it; its events are sorted with spilling.

Template: `<|im_start|>role<|im_sep|>text<|im_end|>` and a line break for each message. In roles and texts a backslash is
doubled and `<|` becomes `<\\|`, so no control string can stand in them, and undoing it is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """The final messages of each conversation: conv_id, message, role, text."""
    log = events.select("conv_id", "message", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("dropped", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
    live = log.where(F.col("dropped").isNull() | (F.col("seq") > F.col("dropped")))
    told = live.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("events"))
    resets = F.transform("events", lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(F.lit(1)))
    told = told.withColumn("last", F.array_max(resets))
    text = F.array_join(F.transform(F.slice("events", F.col("last"), F.size("events")), lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"])), "")
    roles = F.filter(F.transform("events", lambda e: e["role"]), lambda r: r != "")
    return told.select("conv_id", "message", F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in code points of each trained text) and loss_bytes (the same in UTF-8 bytes)."""
    cut = messages.select("conv_id", "message", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == TRAINED).alias("trained"))
    cut = cut.withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    span = lambda size: F.struct((F.coalesce(F.sum(size("segment")).over(before), F.lit(0)) + size("head")).alias("start"), size("body").cast("long").alias("length"))
    laid = cut.select("conv_id", "message", "segment", "trained", span(F.char_length).alias("chars"), span(F.octet_length).alias("bytes"))
    turns = F.array_sort(F.collect_list(F.struct("message", "segment", "trained", "chars", "bytes")))
    whole = laid.groupBy("conv_id").agg(turns.alias("turns"))
    spans = lambda name: F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: t[name])
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"), spans("chars").alias("loss_spans"), spans("bytes").alias("loss_bytes"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a table of conv_id, formatted (as bytes), loss_bytes holds: turns, and the text under the loss mask."""
    f = formatted.withColumn("text", F.decode("formatted", "UTF-8"))
    parts = f.withColumn("parts", F.split("text", r"<\|im_start\|>"))
    parts = parts.withColumn("parts", F.slice("parts", F.lit(2), F.size("parts")))
    turn = lambda s: F.concat(unescape(F.substring_index(s, SEP, 1)), F.lit("\n"), unescape(F.substring_index(F.substring_index(s, SEP, -1), END, 1)), F.lit("\n"))
    trained = F.transform("loss_bytes", lambda p: unescape(F.decode(F.substring(F.col("formatted"), p["start"].cast("int") + 1, p["length"].cast("int")), "UTF-8")))
    read = parts.select("conv_id", F.size("parts").cast("long").alias("n_turns"), F.array_join(F.transform("parts", turn), "").alias("turns"), F.array_join(trained, "").alias("loss"), F.char_length("text").cast("long").alias("formatted_chars"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return read.select("conv_id", "n_turns", sha("turns").alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), sha("loss").alias("loss_sha256"), "formatted_chars")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table with one row for each turn as the log of a live conversation. Rows of the same turn are messages of their own, by role and text.

    A trained turn is streamed: an opened message, a delta of a first attempt, a regeneration, and its text in three
    deltas. Any other turn is sent with the first half of its text and then edited to the whole.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", F.row_number().over(order).alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    third = F.ceil(F.char_length("text") / 3).cast("int")
    part = lambda k: F.substring(F.col("text"), third * k + 1, third)
    event = lambda kind, text, role=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    streamed = F.array(event("message", F.lit(""), F.col("role")), event("delta", F.concat(part(0), F.lit("..."))), event("regenerate", F.lit("")), *(event("delta", part(k)) for k in range(3)))
    edited = F.array(event("message", F.substring(F.col("text"), F.lit(1), (F.char_length("text") / 2).cast("int")), F.col("role")), event("edit", F.col("text")))
    told = turns.select("conv_id", "message", F.posexplode(F.when(F.col("role") == TRAINED, streamed).otherwise(edited)).alias("k", "e"))
    return told.select("conv_id", "message", (F.col("message").cast("long") * 8 + F.col("k")).alias("seq"), "e.kind", "e.role", "e.text")
