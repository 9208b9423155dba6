"""Chat formatting with typed content parts.

A message has a role and an ordered list of parts: text, image, audio or
document. A visitor (one function for each kind of part) flattens the parts to
text with placeholders, in order, and records for every part that isn't text
what it refers to and how many tokens it will take once expanded. Messages then
become template text:

    <|turn|>ROLE\\nBODY<|end|>\\n

Control strings inside roles and texts are escaped: every backslash is doubled,
then a backslash is put after the first character of each control string. A
backslash followed by any character stands for that character, so nothing is
lost, and no text can forge a marker.

The formatted form of a conversation is a sequence of rows, one for each turn,
whose ``chunk`` strings follow each other. A conversation of any length stays a
stream: no task holds more than a batch of it.

Defined results: a null text, part list or role counts as empty; a null turn
comes first; rows with equal turns are ordered by role, then by body; repeated
rows count each; a null conversation id is a conversation of its own; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Control strings as written in a text, and as escaped. Fixed values of the template.
CONTROLS = ("<|", "</s>", "<s>", "[/INST]", "[INST]", "<</SYS>>", "<<SYS>>")

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Tokens that parts take: an image one for each patch, audio by the second, a document by the page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25.0, 512


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def escape_role(role: Column) -> Column:
    """As ``escape``; a line break, which ends the role, becomes backslash, n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


# -- the visitor: one pair of functions for each kind of part ----------------

def visit_text(p: Column) -> tuple[Column, Column]:
    return escape(F.coalesce(p["text"], F.lit(""))), F.lit(0)


def visit_image(p: Column) -> tuple[Column, Column]:
    patches = F.ceil(p["width"] / F.lit(PATCH)) * F.ceil(p["height"] / F.lit(PATCH))
    return F.lit("image"), F.coalesce(patches, F.lit(1))


def visit_audio(p: Column) -> tuple[Column, Column]:
    return F.lit("audio"), F.coalesce(F.ceil(p["seconds"] * F.lit(AUDIO_RATE)), F.lit(1))


def visit_document(p: Column) -> tuple[Column, Column]:
    return F.lit("document"), F.coalesce(p["pages"] * F.lit(PAGE_TOKENS), F.lit(PAGE_TOKENS))


VISITORS = {"image": visit_image, "audio": visit_audio, "document": visit_document}


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """Body text with placeholders, and the attachments in the order of their placeholders.

    A placeholder is ``<|KIND:POSITION|>``, where the position is the part's index
    in its message. A part of an unknown kind is text.
    """
    def render(p: Column, i: Column) -> Column:
        out = visit_text(p)[0]
        for kind, visit in VISITORS.items():
            mark = F.concat(F.lit("<|"), visit(p)[0], F.lit(":"), i.cast("string"), F.lit("|>"))
            out = F.when(p["type"] == kind, mark).otherwise(out)
        return out

    def attach(p: Column, i: Column) -> Column:
        tokens = F.lit(0).cast("long")
        for kind, visit in VISITORS.items():
            tokens = F.when(p["type"] == kind, visit(p)[1].cast("long")).otherwise(tokens)
        return F.struct(i.alias("position"), p["type"].alias("kind"), p["ref"].alias("ref"), tokens.alias("tokens"))

    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    attached = F.filter(F.transform(parts, attach), lambda a: a["kind"].isin(*VISITORS))
    return F.array_join(F.transform(parts, render), ""), attached


def format_turns(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, parts) as template text, one row for each.

    ``chunk`` is the turn's text; ``loss_start`` and ``loss_chars`` say which code
    points of it the loss covers (none unless the assistant speaks).
    """
    body, attached = flatten_parts(F.col("parts"))
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(TURN), escape_role(role), F.lit("\n"))
    rows = messages.select("conv_id", "turn", role.alias("role"), head.alias("head"), body.alias("body"),
                           attached.alias("attachments"))
    return rows.select(
        "conv_id", "turn", "role", F.concat("head", "body", F.lit(END)).alias("chunk"),
        F.length("head").cast("long").alias("loss_start"),
        F.when(F.col("role") == "assistant", F.length("body")).otherwise(0).cast("long").alias("loss_chars"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"))


def read_turn(chunk: str) -> tuple[str, str]:
    """Role and body text of a chunk that ``format_turns`` wrote."""
    if not chunk.startswith(TURN) or not chunk.endswith(END):
        raise ValueError("no turn markers")
    role, _, body = chunk[len(TURN):-len(END)].partition("\n")
    return unescape_role(role), unescape(body)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, attachment_tokens long")


def digest_conversations(turns: DataFrame) -> DataFrame:
    """Read formatted conversations back: what was said, and what lies under the loss mask.

    A SHA-256 takes its bytes in order, so one task reads a conversation from first
    to last turn; it streams, and holds a batch and the state of two hashes.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("attachment_tokens", pa.int64())])

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for b in it:
            for conv, chunk, start, length, tokens in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = read_turn(chunk)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                masked = unescape(chunk[start:start + length]) if length else ""
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(chunk)
                state[5] += tokens
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "chunk")
    return ordered.select("conv_id", "chunk", "loss_start", "loss_chars", "attachment_tokens").mapInArrow(digest, DIGEST)


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            *(F.lit(None).cast(t).alias(n) for n, t in (
                                ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"),
                                ("pages", "int")))))


def conversations(rows: DataFrame) -> DataFrame:
    """Table ``conversations`` (conv_id, turn, role, text): format, then read back and digest."""
    messages = rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    return digest_conversations(format_turns(messages))
