"""Chat formatting: typed content parts, flattened in order into one marked text with a loss mask.

A turn's content is a list of parts (kind, text, ref, tokens). A visitor (one expression per
kind, in ``VISITORS``) turns each part into text: neighbouring text parts are escaped as one text, image, audio and
document parts become numbered placeholders, whose reference and expanded token count are
recorded beside the text.

Template: ``<|im_start|>role`` newline text ``<|im_end|>`` newline, for each turn. Inside texts
and roles a backslash is doubled, and the first character of every control string (``<|``, ``<s>``,
``</s>``, ``[INST]``, ``[/INST]``, ``[IMG]`` and the like) is replaced by an escape, so no control string comes from a
text, and ``read_back`` restores the exact characters. The loss mask is a list of (start, length)
in code points: each assistant text once, without markers.

Defined results: null texts are empty; null roles are empty; turns with equal number go by role
and text; repeated rows are repeated turns; conversations without rows do not exist; extra
columns are ignored. A conversation is one output row, so it is the largest unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<kind:string,text:string,ref:string,tokens:int>"
#: Expanded tokens of an attachment whose part gives no count (fixed values).
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}

#: (plain pattern, replacement, escaped pattern, restored), applied left to right and restored right to left.
_ESCAPES = (
    ("\\\\", "\\\\\\\\"),
    ("<(\\||/?s>)", "\\\\l$1"),
    ("\\[(/?[A-Z_]+\\])", "\\\\b$1"),
)


def escape(text: Column) -> Column:
    for pattern, to in _ESCAPES:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return text


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: doubled backslashes are set aside, then the marks are restored."""
    parts = F.split(text, "\\\\\\\\", -1)
    plain = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, F.lit("\\\\l"), F.lit("<")), F.lit("\\\\b"), F.lit("[")))
    return F.array_join(plain, "\\")


def _header(role: Column) -> Column:
    return F.regexp_replace(escape(role), F.lit("\n"), F.lit("\\\\n"))


def _placeholder(kind: str, part: Column, number: Column) -> Column:
    return F.concat(F.lit(f"<|{kind}_"), number.cast("string"), F.lit("|>"))


#: What each kind of part becomes; unknown kinds are treated as text.
VISITORS = {kind: (lambda part, number, kind=kind: _placeholder(kind, part, number)) for kind in DEFAULT_TOKENS}


def flatten_parts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, plain, attachments) from (conv_id, turn, role, parts)."""
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    is_file = lambda p: F.coalesce(p["kind"].isin(*VISITORS), F.lit(False))

    def visit(p: Column, i: Column) -> Column:
        """A placeholder, or the whole run of text parts that begins here: a control string may lie across parts."""
        number = F.size(F.filter(F.slice(parts, 1, i), is_file)) + 1
        text = lambda q: F.coalesce(q["text"], F.lit(""))
        goes_on = (i > 0) & ~is_file(F.get(parts, i - 1))
        behind = F.slice(parts, i + 1, F.size(parts))
        next_file = F.array_position(F.transform(behind, is_file), F.lit(True)).cast("int")
        run = F.slice(behind, F.lit(1), F.when(next_file > 0, next_file - 1).otherwise(F.size(behind)))
        out = F.when(~is_file(p), F.when(goes_on, F.lit("")).otherwise(escape(F.array_join(F.transform(run, text), ""))))
        for kind, visitor in VISITORS.items():
            out = out.when(p["kind"] == kind, visitor(p, number))
        return out

    def record(p: Column, i: Column) -> Column:
        tokens = p["tokens"]
        for kind, n in DEFAULT_TOKENS.items():
            tokens = F.coalesce(tokens, F.when(p["kind"] == kind, F.lit(n)))
        return F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), tokens.alias("tokens"), (i + 1).alias("number"))

    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.array_join(F.transform(parts, visit), "").alias("body"),
                        F.transform(F.filter(parts, is_file), record).alias("attachments"))


def text_turns(rows: DataFrame) -> DataFrame:
    """Turns whose content is one text part, from (conv_id, turn, role, text)."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
                    F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in code points), attachments, n_turns, expanded_tokens."""
    flat = flatten_parts(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "attachments"))).alias("t"))
    head = lambda x: F.concat(F.lit(START), _header(x["role"]), F.lit("\n"))
    rendered = flat.select("conv_id", F.transform("t", lambda x: F.struct(
        head(x).alias("head"), x["body"].alias("body"), (x["role"] == loss_role).alias("loss"), x["attachments"].alias("attachments"))).alias("t"))
    tail = len(END) + 1
    # running start of each turn, in code points
    state = F.aggregate("t", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")), lambda a, x: F.struct(
        (a["at"] + F.length(x["head"]) + F.length(x["body"]) + tail).alias("at"),
        F.when(x["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))))
        .otherwise(a["spans"]).alias("spans")))
    files = F.flatten(F.transform("t", lambda x: x["attachments"]))
    return rendered.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "").alias("formatted"),
                           state["spans"].alias("loss_spans"), files.alias("attachments"), F.size("t").alias("n_turns"),
                           F.aggregate(files, F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("expanded_tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text (unescaped texts under the mask), parsed from the output alone."""
    pieces = F.filter(F.split("formatted", "<\\|im_start\\|>", -1), lambda p: p != "")
    body = lambda p: F.regexp_replace(p, F.lit("<\\|im_end\\|>\n$"), F.lit(""))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        return F.struct(unescape(F.regexp_replace(head, F.lit("(?<!\\\\)((?:\\\\\\\\)*)\\\\n"), F.lit("$1\n"))).alias("role"),
                        unescape(F.substr(body(p), F.length(head) + 2)).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return chats.select("conv_id", F.transform(pieces, turn).alias("turns"), loss.alias("loss_texts"), "formatted")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from what is read back."""
    back = read_back(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
