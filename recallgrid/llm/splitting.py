"""Cutting oversized texts, and oversized runs of messages, at natural boundaries with an overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import running_sum

CHARS_PER_TOKEN = 4
LIMIT, OVERLAP = 900, 60

#: Natural boundaries a message can end on, strongest first.
HINTS = ("chapter", "scene", "time", "location")

#: Noncharacters that end a message inside a joined run: one for each hint, in that order, and one for none.
MARKS = tuple(chr(0xFDD0 + i) for i in range(len(HINTS) + 1))
MARK_CLASS = "[" + "".join(MARKS) + "]"

#: Ends of a piece by falling strength, as look-behinds.
ENDS = (
    ("paragraph", r"(?<=\n[ \t\r]{0,8}\n)"),
    ("line", r"(?<=\n)"),
    ("sentence", r"(?<=[.!?…。！？][\"'”“’»)\]]{0,3}\s)"),
    ("clause", r"(?<=[,;:—–]\s)"),
    ("word", r"(?<=\s)"),
    ("character", r"(?![\p{M}\x{200D}\x{FE0F}\x{1F3FB}-\x{1F3FF}])(?<!\x{200D})"),
)


def _ends(with_messages: bool) -> list[tuple[str, str]]:
    marks = [(name, f"(?<={mark})") for name, mark in zip((*HINTS, "message"), MARKS)] if with_messages else []
    return [*marks, *ENDS]


def pattern(step: int, reach: int, with_messages: bool = False) -> str:
    """Alternatives by falling boundary strength, each taking as much as fits and at least `reach`; at last any characters."""
    tries = [rf".{{1,{step}}}\z", *(f".{{{reach},{step}}}{end}" for _, end in _ends(with_messages)), f".{{1,{step}}}"]
    return "(?s)" + "|".join(tries)


def tokens_of(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def _cuts(text: Column, limit: int, overlap: int) -> Column:
    """The text in consecutive parts without overlap; the text itself if it is within the limit."""
    size, step = limit * CHARS_PER_TOKEN, (limit - overlap) * CHARS_PER_TOKEN
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(pattern(step, step // 2)), F.lit(0)))


def _starts(cuts: Column) -> Column:
    """Where the parts start, and the end of the last, in characters."""
    return F.aggregate(cuts, F.array(F.lit(0).cast("bigint")), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))


def _boundary(part: Column, with_messages: bool) -> Column:
    """The strongest boundary that a part ends on, by its last characters."""
    kind, tail = F.when(F.lit(False), F.lit("")), F.right(part, F.lit(16))
    for name, end in _ends(with_messages)[:-1]:
        kind = kind.when(tail.rlike(f"(?s){end}\\z"), F.lit(name))
    return kind.otherwise(F.lit("character"))


def split_texts(df: DataFrame, keep: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """`keep`, n_pieces, piece_no, start_pos, end_pos, boundary, n_tokens and text: every text in pieces of at most `limit` tokens.

    tokens = ceil(characters / 4), whatever any stored count says. A text within the limit is one piece. A larger one is
    read by one regular expression whose alternatives, strongest boundary first (blank line, line, sentence, clause,
    word, character), take as much as fits and at least half of it; a run without any boundary is cut at the limit, not inside a
    combined character if that can be helped. Each piece but the first begins with the last `overlap` tokens
    (4 * overlap characters) before it. Null texts give no piece, an empty text one empty piece. Rows are taken one by
    one, repeated ones too; there is no shuffle.
    """
    # a column of its own for what the lambda below refers to again and again, else it would be computed at every piece
    parts = df.select(*keep, _cuts(F.col(text), limit, overlap).alias("__cuts")).where("__cuts is not null").withColumn("__starts", _starts(F.col("__cuts")))
    n, back = F.size("__cuts"), overlap * CHARS_PER_TOKEN

    def piece(p: Column, i: Column) -> Column:
        before = F.when(i > 0, F.right(F.get(F.col("__cuts"), i - 1), F.lit(back))).otherwise(F.lit(""))
        boundary = F.when(i == n - 1, F.lit("end")).otherwise(_boundary(p, False))
        return F.struct(i.alias("piece_no"), (F.get("__starts", i) - F.length(before)).alias("start_pos"), F.get("__starts", i + 1).alias("end_pos"), boundary.alias("boundary"), F.concat(before, p).alias("text"))

    rows = parts.select(*keep, n.alias("n_pieces"), F.inline(F.transform("__cuts", piece)))
    return rows.select(*keep, "n_pieces", "piece_no", "start_pos", "end_pos", "boundary", tokens_of(F.col("text")).alias("n_tokens"), "text")


def split_oversized(df: DataFrame, keep: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """`split_texts` of the texts above the limit only; the others are left out before any cutting."""
    return split_texts(df.where(tokens_of(F.col(text)) > limit), keep, text, limit, overlap)


def hint_mark(hint: Column) -> Column:
    """The mark of the strongest hint named in a boundary_hint, a word or a list of words written in any way."""
    found = F.lit(None).cast("string")
    for name, mark in reversed(list(zip(HINTS, MARKS))):
        found = F.when(F.lower(hint).rlike(rf"(?<![a-z]){name}(?![a-z])"), F.lit(mark)).otherwise(found)
    return F.coalesce(found, F.lit(MARKS[-1]))


def split_runs(messages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, block_pieces: int = 64) -> DataFrame:
    """chat_id, start_pos, end_pos, first_index, boundary, n_tokens and text: every chat above the limit as ordered pieces of its run of messages.

    The messages of a chat in the order of message_index, each ended by a line end, are read as one text, by the same
    rule as `split_texts` with the ends of messages before all others: those hinted as chapter, scene, time, location, then any.
    Of several rows with the same (chat_id, message_index) the last ingested counts (ties: the largest message_id). Rows without
    chat, index or text are left out, chats within the limit too. start_pos counts characters of the chat's text. Every piece but a chat's first begins with the
    4 * overlap characters before it.

    A chat may hold a third of all rows, so no task reads a whole chat: a two-level running sum places every message, and in each window of about `block_pieces` pieces
    the chat is cut behind the message with the strongest hint (of equally strong ones the last). Blocks between such ends are split by themselves; a block's last piece ends where the block does, on a
    natural boundary, and may be short. The overlap into a block comes from as many messages before it as it takes, found by an equi-join on their place.
    """
    size, back = limit * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN
    width = block_pieces * (size - back)
    usable = messages.where("chat_id is not null and message_index is not null and text is not null")
    newest = F.max_by(F.struct(F.col("text"), F.col("boundary_hint")), F.struct(F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp_ntz").cast(dict(messages.dtypes)["ingested_at"])), F.col("message_id")))
    unique = usable.groupBy("chat_id", "message_index").agg(newest.alias("m")).select("chat_id", "message_index", F.concat("m.text", hint_mark(F.col("m.boundary_hint"))).alias("t"))
    sized = unique.withColumn("n", F.length("t").cast("long"))
    placed = running_sum(sized, ["chat_id"], "message_index", "n", "at").withColumn("window", F.floor(F.col("at") / width))
    strength = F.struct(-F.array_position(F.array(*(F.lit(m) for m in MARKS)), F.right("t", F.lit(1))), F.col("at"))
    # one end a window: a block begins behind it; up to the first end, and behind the last, blocks of their own
    ends = placed.groupBy("chat_id", "window").agg(F.max_by(F.col("at") + F.col("n"), strength).alias("end"))
    with_end = placed.join(ends, ["chat_id", "window"]).withColumn("block", F.col("window") * 2 + (F.col("at") >= F.col("end")).cast("long"))
    # behind a window's end and before the next one's lies one block: 2w + 1 and 2(w + 1) are the same
    numbered = with_end.withColumn("block", F.floor((F.col("block") + 1) / 2))
    rows = F.array_sort(F.collect_list(F.struct("at", "message_index", "t")))
    blocks = (
        numbered.groupBy("chat_id", "block")
        .agg(rows.alias("rows"))
        .select("chat_id", F.element_at("rows", 1)["at"].alias("first_at"), F.element_at("rows", 1)["message_index"].alias("first_index"), F.array_join(F.transform("rows", lambda r: r["t"]), "").alias("t"))
    )
    # messages that reach into the `back` characters before a block: each holds a character at least, so there are at most as many
    ends_at = F.col("at") + F.col("n")
    reach = F.array_distinct(F.array(F.floor((F.col("first_at") - 1) / back), F.floor((F.col("first_at") - back) / back)))
    wanted = blocks.where("first_at > 0").select("chat_id", "first_at", F.explode(reach).alias("slot"))
    offered = placed.select("chat_id", "at", F.right("t", F.lit(back)).alias("end_text"), ends_at.alias("ends_at"), F.floor((ends_at - 1) / back).alias("slot"))
    near = wanted.join(offered, ["chat_id", "slot"]).where("ends_at <= first_at and ends_at > first_at - %d" % back)
    tails = near.groupBy("chat_id", "first_at").agg(F.array_sort(F.collect_list(F.struct("at", "end_text"))).alias("near")).select("chat_id", "first_at", F.right(F.array_join(F.transform("near", lambda r: r["end_text"]), ""), F.lit(back)).alias("tail"))
    lasts = placed.groupBy("chat_id").agg(F.max(F.col("at") + F.col("n")).alias("chars")).where(F.col("chars") > size)
    lined = blocks.join(tails, ["chat_id", "first_at"], "left").join(lasts.select("chat_id"), "chat_id", "left_semi")
    # room for the overlap is kept: pieces hold at most size - back fresh characters
    step = size - back
    cuts = F.regexp_extract_all("t", F.lit(pattern(step, step // 2, True)), F.lit(0))
    opened = lined.withColumn("cuts", cuts).withColumn("starts", _starts(F.col("cuts")))

    def piece(p: Column, i: Column) -> Column:
        # what lies before a piece in its block, and before that the tail of the blocks before
        own = F.substring(F.col("t"), F.greatest(F.get("starts", i) - back, F.lit(0)).cast("int") + 1, F.least(F.get("starts", i), F.lit(back)).cast("int"))
        before = F.right(F.concat(F.coalesce("tail", F.lit("")), own), F.lit(back))
        start = F.col("first_at") + F.get("starts", i)
        shown = F.translate(F.concat(before, p), "".join(MARKS), "\n" * len(MARKS))
        return F.struct((start - F.length(before)).alias("start_pos"), (start + F.length(p)).alias("end_pos"), _boundary(p, True).alias("boundary"), shown.alias("text"))

    out = opened.select("chat_id", "first_index", F.inline(F.transform("cuts", piece)))
    return out.select("chat_id", "start_pos", "end_pos", "first_index", "boundary", tokens_of(F.col("text")).alias("n_tokens"), "text")


def oversized(df: DataFrame, row_id: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The ids of the rows that `split_texts` gives in more than one piece."""
    return split_texts(df, [row_id], text, limit).where("n_pieces > 1 and piece_no = 0").select(row_id)
