"""Chat formatting with a grammar round trip: what was rendered is parsed again, and conflicting text is escaped until both agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grammar, levels apart: chat := "<chat LEVEL>\n" turn*; turn := "### ROLE:\n" TEXT " </turn>\n".
#: At level 0 roles and texts stand as they are. At level 1 a backslash is doubled and one is put within "</turn"; in
#: roles a line feed becomes "<\\n". A lone backslash after "<" never comes from a doubled one, so both are undone.
_TURN = r"(?s)### ([^\n]*):\n(.*?) </turn>\n"


def _escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("</turn"), F.lit("<\\/turn")), F.lit("\n"), F.lit("<\\n"))


def _unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("<\\n"), F.lit("\n")), F.lit("<\\/turn"), F.lit("</turn"))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _escape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("</turn"), F.lit("<\\/turn"))


def _render(level: int) -> Column:
    turn = (lambda t: F.concat(F.lit("### "), t["role"], F.lit(":\n"), t["text"], F.lit(" </turn>\n"))) if not level else (lambda t: F.concat(F.lit("### "), _escape(t["role"]), F.lit(":\n"), _escape_text(t["text"]), F.lit(" </turn>\n")))
    return F.concat(F.lit(f"<chat {level}>\n"), F.array_join(F.transform("turns", turn), ""))


def _parse(df: DataFrame, rendered: str, out: str, level: Column) -> DataFrame:
    """out: the turns that the grammar finds in rendered; text that it can't derive makes one turn with a null role."""
    body = F.regexp_replace(rendered, r"\A<chat [01]>\n", "")
    df = df.withColumn("_roles", F.regexp_extract_all(body, F.lit(_TURN), 1)).withColumn("_texts", F.regexp_extract_all(body, F.lit(_TURN), 2))
    whole = F.concat(F.lit(""), F.array_join(F.zip_with("_roles", "_texts", lambda r, t: F.concat(F.lit("### "), r, F.lit(":\n"), t, F.lit(" </turn>\n"))), ""))
    plain = F.zip_with("_roles", "_texts", lambda r, t: F.struct(r.alias("role"), t.alias("text")))
    back = F.zip_with("_roles", "_texts", lambda r, t: F.struct(_unescape(r).alias("role"), _unescape(t).alias("text")))
    wrong = F.array(F.struct(F.lit(None).cast("string").alias("role"), body.alias("text")))
    return df.withColumn(out, F.when(whole != body, wrong).when(level == 0, plain).otherwise(back)).drop("_roles", "_texts")


def format_chats(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation: conv_id, turns, formatted, level, parsed turns, and the loss mask of formatted.

    Turns stand in order of turn, then role and text. The plain rendering is parsed; if the recovered turns differ
    from the source, the escaped one is taken, which always agrees. loss is run lengths over the code points of
    formatted: (length, masked, escaped text), masked runs being the texts of loss_roles. Null text or role is empty;
    null turns come first; null conv_id is a conversation of its own. Repeated rows are repeated turns. Other
    columns are not read, whatever their names. An empty table gives no conversation.
    """
    said = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    chats = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    chats = chats.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).withColumn("plain", _render(0))
    chats = _parse(chats, "plain", "again", F.lit(0)).withColumn("level", F.when(F.col("again") == F.col("turns"), 0).otherwise(1))
    chats = chats.select("conv_id", "turns", "level", F.when(F.col("level") == 0, F.col("plain")).otherwise(_render(1)).alias("formatted"))
    chats = _parse(chats, "formatted", "parsed", F.col("level"))
    shown = lambda role, t: F.when(F.col("level") == 0, t).otherwise(_escape(t) if role else _escape_text(t))
    run = lambda n, masked, text: F.struct(n.cast("long").alias("length"), masked.alias("masked"), text.alias("text"))
    none = F.lit("")
    runs = F.flatten(F.transform("parsed", lambda t: F.array(run(F.length(shown(True, t["role"])) + 6, F.lit(False), none), run(F.length(shown(False, t["text"])), t["role"].isin(*loss_roles), shown(False, t["text"])), run(F.lit(9), F.lit(False), none))))
    return chats.withColumn("loss", F.concat(F.array(run(F.lit(9), F.lit(False), none)), runs))


def report(found: DataFrame) -> DataFrame:
    line = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform(F.filter("loss", lambda r: r["masked"]), lambda r: r["text"])
    out = found.withColumn("loss_text", F.array_join(F.transform(masked, lambda t: F.when(F.col("level") == 0, t).otherwise(_unescape(t))), ""))
    return out.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
