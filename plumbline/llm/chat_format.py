"""Chat formatting: typed content parts become one string per conversation, which reads back without loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._common import running

# The template: <s>[ROLE]role[/ROLE]content</s> for each turn.
OPEN, NAMED, CLOSE, BETWEEN = "<s>[ROLE]", "[/ROLE]", "</s>", "[PART]"
#: Control strings as they may stand in a text. A backslash goes in after the first character, and one comes out
#: again; strings that held backslashes there already get one more, so that the way back is exact.
CONTROL = r"/?(?:s>|(?:ROLE|INST|PART|SYS)\]|(?:IMAGE|AUDIO|DOCUMENT):)"
#: Tokens that one unit of a part expands to: an image's patches, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 1, "audio": 25, "document": 512}
#: Code points that a formatted string is cut into before spans are taken from it.
CUT = 1024
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def text_parts(text: Column) -> Column:
    """A plain text column as content parts."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units"))).cast(f"array<{PART}>")


def visit(part: Column, place: Column) -> Column:
    """What a part becomes: its escaped text, or a placeholder with its kind and its place among the turn's parts."""
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    placeholder = F.concat(F.lit("["), F.upper(kind), F.lit(":"), place.cast("string"), F.lit("]"))
    return F.when(kind.isin(*UNIT_TOKENS), placeholder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def expanded(part: Column) -> Column:
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    rate = F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in UNIT_TOKENS.items()], F.lit(0))
    return (F.greatest(F.coalesce(part["units"], F.lit(0)), F.lit(0)) * rate).cast("long")


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: str = "assistant") -> DataFrame:
    """One row per conversation: its formatted string, the loss mask and the attachments.

    `parts` is an array of (kind, text, ref, units); kinds are text, image, audio and document, others count as text.
    Parts of a turn are kept apart by a part mark. loss_mask lists (start, length) in code points of the text parts of
    `learn` turns; placeholders are not learned. attachments lists (turn_place, part_place, kind, ref, n_tokens) in order;
    n_expanded is their sum. Turns go by turn, then role, then content, so ties and repeated rows have one order; a null
    turn goes first; a null role is the empty role; null or no parts are one empty text; null conversations form one
    conversation; no rows give no rows. Other columns are not read. One conversation is one row by its nature: its turns
    meet in one task.
    """
    given = F.coalesce(F.when(F.size(parts) > 0, F.col(parts)), text_parts(F.lit(""))).cast(f"array<{PART}>")
    is_file = lambda p: F.coalesce(F.lower(p["kind"]).isin(*UNIT_TOKENS), F.lit(False))
    visited = F.transform(given, lambda p, i: F.struct(visit(p, i).alias("s"), is_file(p).alias("file")))
    files = F.filter(F.transform(given, lambda p, i: F.struct(i.alias("part_place"), F.lower(p["kind"]).alias("kind"), p["ref"].alias("ref"), expanded(p).alias("n_tokens"))), lambda a: a["kind"].isin(*UNIT_TOKENS))
    head = F.concat(F.lit(OPEN), escape(F.coalesce(F.col(role), F.lit(""))), F.lit(NAMED))
    rows = turns.select(conversation, F.col(turn).alias("_turn"), F.col(role).alias("_role"), head.alias("_head"), visited.alias("_visited"), files.alias("_files"))
    ends = running(f"transform(_visited, p -> char_length(p.s) + {len(BETWEEN)})", "{a} + {b}", 0, "r")
    texts = F.filter(F.zip_with("_visited", F.expr(ends), lambda p, e: F.struct(p["file"].alias("file"), (e - F.char_length(p["s"]) - len(BETWEEN)).alias("start"), F.char_length(p["s"]).alias("length"))), lambda t: ~t["file"])
    rows = rows.withColumn("_content", F.array_join("_visited.s", BETWEEN)).withColumn("_texts", texts).drop("_visited")
    along = Window.partitionBy(conversation).orderBy("_turn", "_role", "_content", "_files")
    ends = F.sum(F.char_length("_head") + F.char_length("_content") + len(CLOSE)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_place", F.row_number().over(along) - 1).withColumn("_start", ends - F.char_length("_content") - len(CLOSE))
    learned = F.when(F.col("_role") == learn, F.transform("_texts", lambda t: F.struct((F.col("_start") + t["start"]).cast("long").alias("start"), t["length"].cast("long").alias("length"))))
    turn_row = F.struct("_place", "_head", "_content", F.coalesce(learned, F.array().cast("array<struct<start:bigint,length:bigint>>")).alias("learned"), "_files")
    ordered = placed.groupBy(conversation).agg(F.sort_array(F.collect_list(turn_row)).alias("ts"))
    text = F.array_join(F.transform("ts", lambda t: F.concat(t["_head"], t["_content"], F.lit(CLOSE))), "")
    attached = F.flatten(F.transform("ts", lambda t: F.transform(t["_files"], lambda f: F.struct(t["_place"].alias("turn_place"), f["part_place"], f["kind"], f["ref"], f["n_tokens"]))))
    out = ordered.select(conversation, text.alias("formatted"), F.flatten("ts.learned").alias("loss_mask"), attached.alias("attachments"))
    return out.withColumn("n_expanded", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]))


def _bind(value: Column, body) -> Column:
    """body of the struct `value`, which is computed once; inside a lambda a column may be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _under(blocks: Column, start: Column, length: Column) -> Column:
    """`length` code points from `start` of a string that is given in blocks of CUT: only the blocks in reach are read."""
    first = F.floor(start / CUT).cast("int")
    last = F.greatest(first, F.floor((start + length - 1) / CUT).cast("int"))
    near = F.array_join(F.transform(F.sequence(first, last), lambda i: F.coalesce(F.get(blocks, i), F.lit(""))), "")
    return F.substring(near, (start - first * CUT + 1).cast("int"), length.cast("int"))


def read_chats(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Read formatted strings back: turns as (role, text, parts), and the learned texts under the loss mask, unescaped.

    Parts are (kind, text, ref): marks and placeholders inside texts are escaped, so those that are not are real, and the
    n-th of them is the n-th attachment. `text` is the turn's text parts, one after the other. The string is split once, and
    cut into blocks once for the mask, so the work is linear in a conversation's length and turns.
    """
    placeholder = rf"^\[({'|'.join(k.upper() for k in UNIT_TOKENS)}):[0-9]+\]$"
    files = lambda parts: F.size(F.filter(parts, lambda p: p.rlike(placeholder)))

    def halves(p: Column) -> Column:
        named = F.split(p, r"\[/ROLE\]", 2)
        return F.struct(unescape(F.regexp_replace(named[0], r"^<s>\[ROLE\]", "")).alias("role"), F.split(named[1], r"\[PART\]", -1).alias("given"))

    def counted(t: Column) -> Column:
        return F.struct(t["role"].alias("role"), t["given"].alias("given"), files(t["given"]).alias("n"))

    raw = F.transform(F.transform(F.expr(f"filter(split(formatted, '{CLOSE}'), p -> p <> '')"), halves), counted)
    # attachments before each turn, and before each part of a turn
    before_turns = F.expr(running("transform(_raw, t -> t.n)", "{a} + {b}", 0, "r"))
    kinds = ", ".join(f"'{k.upper()}'" for k in UNIT_TOKENS)
    flags = f"transform(t.given, p -> if(regexp_extract(p, r'{placeholder}', 1) IN ({kinds}), 1, 0))"
    numbered = F.expr(f"transform(_raw, t -> named_struct('role', t.role, 'given', t.given, 'n', t.n, 'ends', {running(flags, '{a} + {b}', 0, 'q')}))")

    def read(v: Column) -> Column:
        def turn(t: Column, end: Column) -> Column:
            def one(p: Column, upto: Column) -> Column:
                kind = F.lower(F.regexp_extract(p, placeholder, 1))
                ref = F.get(v["files"], end - t["n"] + upto - 1)["ref"]
                return F.when(kind != "", F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("text"), ref.alias("ref"))).otherwise(F.struct(F.lit("text").alias("kind"), unescape(p).alias("text"), F.lit(None).cast("string").alias("ref")))

            return F.struct(t["role"].alias("role"), F.zip_with(t["given"], t["ends"], one).alias("parts"))

        return F.transform(F.zip_with(v["turns"], v["ends"], turn), lambda t: F.struct(t["role"].alias("role"), F.array_join(t["parts"]["text"], "").alias("text"), t["parts"].alias("parts")))

    turns = _bind(F.struct(numbered.alias("turns"), before_turns.alias("ends"), F.sort_array("attachments").alias("files")), read)
    blocks = F.expr(f"regexp_extract_all(formatted, r'(?s).{{1,{CUT}}}', 0)")
    learned = _bind(F.struct(blocks.alias("blocks"), F.col("loss_mask").alias("mask")), lambda v: F.transform(v["mask"], lambda s: unescape(_under(v["blocks"], s["start"], s["length"]))))
    # _raw is named by several expressions, so Spark computes it once, in a projection of its own
    return formatted.withColumn("_raw", raw).select(conversation, turns.alias("turns"), learned.alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"))
