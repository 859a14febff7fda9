r"""Chat formatting with a grammar round trip, built from SQL functions only.

Grammar of the rendered text::

    conversation := turn*
    turn         := "<turn " role ">" text "</turn>" "\n"

Escapes inside role and text: ``\s`` for a backslash, ``\l`` for ``<``, ``\g`` for ``>``. The parser
cuts at ``</turn>``, refuses a body that still holds a turn header, and always unescapes. A text is
rendered at the lowest rung at which the parser gives the source back: 0 as it is, 1 with the ``<``
of its control strings escaped, 2 with its backslashes escaped too (which always comes back).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<turn ", "</turn>"
ASSISTANT = "assistant"


def _swap(x: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def escape_text(text: Column, rung: int) -> Column:
    if rung >= 2:
        text = _swap(text, ("\\", "\\s"))
    if rung >= 1:
        text = _swap(text, (OPEN, "\\l" + OPEN[1:]), (CLOSE, "\\l" + CLOSE[1:]))
    return text


def escape_role(role: Column) -> Column:
    return _swap(role, ("\\", "\\s"), ("<", "\\l"), (">", "\\g"))


def unescape(x: Column) -> Column:
    return _swap(x, ("\\l", "<"), ("\\g", ">"), ("\\s", "\\"))


def render(role: Column, text: Column, rung: int) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit(">"), escape_text(text, rung), F.lit(CLOSE + "\n"))


def parse(formatted: Column) -> Column:
    """Turns of a rendered conversation: array of (role, text).

    Anything that the grammar does not allow gives a turn whose role and text are NULL, so it never
    equals a source.
    """
    chunks = F.split(formatted, CLOSE)
    n = F.size(chunks)
    cut = F.transform(
        F.slice(chunks, F.lit(1), n - 1),
        lambda c, i: F.when(i == 0, c).when(F.startswith(c, F.lit("\n" + OPEN)), F.substring(c, 2, 2147483647)),
    )
    head = F.lit(len(OPEN))

    def turn(c: Column) -> Column:
        gt = F.locate(">", c)
        body = F.substr(c, gt + 1)
        fine = F.startswith(c, F.lit(OPEN)) & (gt > 0) & (F.locate(OPEN, body) == 0)
        return F.struct(
            F.when(fine, unescape(F.substr(c, head + 1, gt - head - 1))).alias("role"),
            F.when(fine, unescape(body)).alias("text"),
        )

    return F.transform(cut, turn)


def formatted_turns(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per turn: conv_id, place (from 1), role, text, rendered, rung, and where it is in its conversation.

    Turns are ordered by (turn, role, text), NULL turns first; NULL role and text count as empty.
    ``span`` holds the raw text's start and length in code points, and the same in UTF-8 bytes.
    """
    src = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    for rung in (0, 1):
        made = render(F.col("role"), F.col("text"), rung)
        back = parse(made)
        src = src.withColumn(f"r{rung}", made).withColumn(f"b{rung}", back)
        one = F.get(f"b{rung}", F.lit(0))
        same = (F.size(f"b{rung}") == 1) & one["role"].eqNullSafe(F.col("role")) & one["text"].eqNullSafe(F.col("text"))
        src = src.withColumn(f"ok{rung}", same).drop(f"b{rung}")
    rung = F.when(F.col("ok0"), 0).when(F.col("ok1"), 1).otherwise(2)
    rendered = F.when(F.col("ok0"), F.col("r0")).when(F.col("ok1"), F.col("r1"))
    src = src.select(
        "conv_id", "turn", "role", "text", rung.alias("rung"),
        F.coalesce(rendered, render(F.col("role"), F.col("text"), 2)).alias("rendered"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = len(CLOSE) + 1  # the end mark and the line feed
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">"))

    def span(length, name: str, size: str) -> list[Column]:
        start = F.sum(length("rendered")).over(until) - length("rendered") + length(head)
        return [start.cast("int").alias(name), (length("rendered") - length(head) - tail).cast("int").alias(size)]

    where = F.struct(*span(F.length, "start", "length"), *span(F.octet_length, "byte_start", "byte_length"))
    return src.select("*", F.row_number().over(order).alias("place"), where.alias("span"))


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, rungs, round_trip.

    ``loss_spans`` is an array of (start, length) in code points of ``formatted`` and (byte_start,
    byte_length) in its UTF-8 bytes: the raw texts of the assistant turns. ``round_trip`` says that
    parsing ``formatted`` gave every source turn back: turns end where the grammar says, so it follows
    from the round trip of each turn alone, by which its rung was chosen.

    NULL conv_ids form one conversation; repeated rows, and rows that tie in turn, role and text, are
    turns of their own; an empty table gives no rows. Only the four named columns are read, so other
    columns cannot clash. A conversation is one output row, so its turns meet in one task by
    definition and a very long one has to fit there, at a cost in proportion to its length;
    conversations spread over all tasks.
    """
    turns = formatted_turns(rows, conv_id, turn, role, text)
    parts = F.sort_array(F.collect_list(F.struct("place", "role", "text", "rendered", "rung", "span")))
    df = turns.groupBy("conv_id").agg(parts.alias("parts"))
    df = df.withColumn("formatted", F.array_join(F.transform("parts", lambda p: p["rendered"]), ""))
    source = F.transform("parts", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    found = F.transform(parse(F.col("formatted")), lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    said = F.filter("parts", lambda p: p["role"] == ASSISTANT)
    return df.select(
        "conv_id",
        F.size("parts").cast("long").alias("n_turns"),
        "formatted",
        F.transform(said, lambda p: p["span"]).alias("loss_spans"),
        F.transform("parts", lambda p: p["rung"]).alias("rungs"),
        (source == found).alias("round_trip"),
    )


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped text under the loss mask; cut by bytes, so that no span is counted from the start."""
    raw = formatted.cast("binary")
    cut = F.transform(loss_spans, lambda s: F.substr(raw, s["byte_start"] + 1, s["byte_length"]).cast("string"))
    return F.array_join(F.transform(cut, unescape), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from ``formatted`` and ``loss_spans`` alone, as counts and SHA-256 digests.

    An empty table gives no rows; a conversation without assistant turns has an empty loss text.
    """
    df = formatted.withColumn("back", parse(F.col("formatted")))
    said = F.transform("back", lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n")))
    df = df.select("*", F.array_join(said, "").alias("said"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return df.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
