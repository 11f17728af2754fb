"""Operator 3: chat formatting into budgeted, turn-aligned windows, with built-in functions only.

Template of a turn: `<|im_start|>` role, a line feed, the text, `<|im_end|>`, a line feed. In texts and
roles every `<|` (with any backslashes between the two signs) gets one backslash more, so a text can
never hold a control string, and taking one away again gives the text back exactly. Line feeds in a role
become `\\n` and its backslashes `\\\\`.

Windows: a turn's tokens are counted by `token_count`. Prefix sums over a conversation's turns deal them
into spans by multiples of a stride of `budget - history - system` tokens: the turns that end between two multiples
are a span. A turn that begins up to `history` tokens before a multiple belongs to the span behind it; one that
begins earlier is a span of its own, so a turn is never cut. Each window holds the system turn (a first turn of role
`system`), then as many turns before the span as fit into `history` tokens and into what the span leaves of the
budget, then the span. So no window is over budget but that of a single turn which is longer than the budget leaves
it. Assistant texts of the span are the loss; repeated turns are masked. Every turn is new in exactly one window.

A window has a bounded number of turns, so conversations of any length are worked on in pieces; only
`read_back`, whose digests are of whole conversations, brings the pieces of one together.

Defined results: turns go by (turn, role, text), nulls first; null role and text are empty; rows of a null
conversation id are one conversation; repeated rows are repeated turns; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY = 512
START, END = "<|im_start|>", "<|im_end|>"
#: One token per up to six letters, up to three digits, or other sign.
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^\x09-\x0D\x20\p{L}\p{N}]"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(lines, F.lit("\\\\"), F.lit("\\"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (from 0), n_repeated, text, loss (array of start and length in code points).

    `turns` has conv_id, turn, role, text; its other columns are not looked at.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    conv = Window.partitionBy("conv_id").orderBy(*order)
    upto = conv.rowsBetween(Window.unboundedPreceding, -1)
    piece = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    rows = turns.select("conv_id", "turn", "role", "text", piece.alias("piece"), token_count(piece).alias("tokens"))
    rows = rows.withColumn("i", F.row_number().over(conv).cast("long")).withColumn(
        "system", (F.col("i") == 1) & (F.col("role") == "system"))
    own = F.when(F.col("system"), F.lit(0)).otherwise(F.col("tokens"))
    rows = (rows.withColumn("begin", F.coalesce(F.sum(own).over(upto), F.lit(0))).withColumn("end", F.col("begin") + own)
            .withColumn("head", F.first(F.when(F.col("system"), F.struct("piece", "tokens"))).over(conv)))
    stride = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("head.tokens", F.lit(0)))
    of_begin = F.floor(F.col("begin") / stride)
    of_end = F.greatest(of_begin, F.floor((F.col("end") - 1) / stride))
    alone = (of_end > of_begin) & (of_end * stride - F.col("begin") > history) & ~F.col("system")
    rows = rows.withColumn("span", F.struct(F.when(alone, of_begin).otherwise(of_end).cast("long").alias("k"),
                                            F.when(alone, F.lit(1)).otherwise(F.lit(0)).alias("cut")))
    rows = rows.select("conv_id", "i", "role", "piece", "system", "begin", "end", "span", "head")

    # a turn is repeated by the spans that start at most `room` tokens behind its own start
    reach = F.lit(max(1, history)).cast("long")
    spans = rows.groupBy("conv_id", "span").agg(
        F.min("begin").alias("starts"), F.min("i").alias("first_i"),
        (F.lit(budget) - F.max(F.coalesce("head.tokens", F.lit(0))) - F.sum(F.col("end") - F.col("begin"))).alias("left"))
    room = F.greatest(F.lit(0), F.least(F.lit(history), F.col("left")))
    near = spans.select("conv_id", F.col("span").alias("to"), "starts", "first_i", room.alias("room"), F.floor(F.col("starts") / reach).alias("cell"))
    back = rows.filter(~F.col("system")).withColumn("cell", F.explode(F.array(F.floor(F.col("begin") / reach), F.floor(F.col("begin") / reach) + 1)))
    r, s = back.alias("r"), near.alias("s")
    repeated = (r.join(s, F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.cell") == F.col("s.cell")))
                .filter("r.i < s.first_i AND s.starts - r.begin <= s.room")
                .select("r.conv_id", F.col("s.to").alias("span"), "r.i", F.lit(False).alias("new"), "r.role", "r.piece", "r.head"))
    placed = rows.select("conv_id", "span", "i", F.lit(True).alias("new"), "role", "piece", "head").union(repeated)

    win = placed.groupBy("conv_id", "span").agg(
        F.array_sort(F.collect_list(F.struct("i", "new", "role", "piece"))).alias("turns"), F.first("head").alias("head"),
        F.min(F.when(F.col("new"), F.col("i"))).alias("first_i"))
    with_head = F.col("head").isNotNull() & (F.col("first_i") > 1)
    system = F.struct(F.lit(1).cast("long").alias("i"), F.lit(False).alias("new"), F.lit("system").alias("role"), F.col("head.piece").alias("piece"))
    win = win.withColumn("turns", F.when(with_head, F.concat(F.array(system), F.col("turns"))).otherwise(F.col("turns")))
    lengths = F.transform("turns", lambda t: F.length(t["piece"]))
    place = F.transform(F.sequence(F.lit(0), F.size("turns") - 1),
                        lambda k: F.aggregate(F.slice(F.col("lengths"), F.lit(1), k), F.lit(0), lambda a, b: a + b))
    win = win.withColumn("lengths", lengths).withColumn("place", place)
    head_chars = lambda t: F.length(F.substring_index(t["piece"], "\n", 1)) + 1
    loss = F.transform(
        F.filter(F.arrays_zip("turns", "place"), lambda z: z["turns"]["new"] & (z["turns"]["role"] == "assistant")),
        lambda z: F.struct((z["place"] + head_chars(z["turns"])).alias("start"),
                           (F.length(z["turns"]["piece"]) - head_chars(z["turns"]) - len(END) - 1).alias("length")))
    numbers = Window.partitionBy("conv_id").orderBy("first_i")
    return win.select("conv_id", (F.row_number().over(numbers) - 1).alias("window"),
                      F.size(F.filter("turns", lambda t: ~t["new"])).alias("n_repeated"),
                      F.concat_ws("", F.transform("turns", lambda t: t["piece"])).alias("text"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: turns, digest of all of them, text under the loss."""
    pieces = F.split(F.col("text"), r"<\|im_end\|>\n")
    new = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)))
    turn = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    plain = F.transform(new, lambda p: F.concat(
        unescape_role(F.substring_index(turn(p), "\n", 1)), F.lit("\n"),
        unescape(F.substring(turn(p), F.length(F.substring_index(turn(p), "\n", 1)) + 2, F.length(p))), F.lit("\n")))
    learned = F.concat_ws("", F.transform("loss", lambda x: unescape(F.substring(F.col("text"), x["start"] + 1, x["length"]))))
    parts = formatted.select("conv_id", "window", F.size(new).alias("n"), F.concat_ws("", plain).alias("plain"),
                             learned.alias("learned"), F.length("text").alias("chars"))
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "plain", "learned"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"))
    text = lambda c: F.concat_ws("", F.transform("w", lambda x: x[c]))
    return whole.select("conv_id", "n_turns", F.sha2(text("plain").cast("binary"), 256).alias("turns_sha256"),
                        F.length(text("learned")).cast("long").alias("loss_chars"),
                        F.sha2(text("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
