"""Chat formatting with typed content parts.

Each turn is one segment, `<s>[ROLE]role[/ROLE]content</s>` with its loss span; a conversation is its segments in
order of turn, so it never has to stand in one row. A visitor flattens a turn's parts: text is escaped, image, audio
and document parts become a placeholder with a running number, and their references and expanded token counts are
recorded beside it. Control strings inside texts get a backslash after their first character (one more where some
stand already), which `unescaped` takes away again.

Edge cases: null text or role counts as empty; a null part is skipped; rows that tie on the turn go by role and text;
a conversation of any length is digested as a stream; a null conv_id is a conversation of its own; an empty table
gives the extra conversation's row alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import shared

# The template's control strings, without their first character.
TAILS = ["s>", "/s>", "ROLE]", "/ROLE]", "INST]", "/INST]", "image:", "audio:", "document:"]
TAIL = "(?:" + "|".join(re.escape(t) for t in TAILS) + ")"
ESCAPE = rf"([<\[])(\\*)(?={TAIL})"
UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={TAIL})")
SEGMENT = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.DOTALL)
LEARNED = "assistant"
PARTS = "array<struct<kind:string, text:string, ref:string, width:int, height:int, seconds:double, pages:int>>"
PLACED = ["image", "audio", "document"]
PATCH, AUDIO_TOKENS_A_SECOND, PAGE_TOKENS = 14, 25, 512


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\")


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text) if "\\" in text else text


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for: image patches, audio frames, or pages."""
    up = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / F.lit(PATCH))
    image = up(part["width"]) * up(part["height"])
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_A_SECOND)
    pages = F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS
    return F.when(part["kind"] == "image", image).when(part["kind"] == "audio", audio).when(part["kind"] == "document", pages).otherwise(F.lit(0)).cast("long")


def flattened(parts: Column) -> Column:
    """A turn's content: each part in order, text escaped, others as `<kind:number>`.

    Neighbouring text parts are one text before it is escaped, so that no control string arises where they meet.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    state = lambda done, text, n: F.struct(done.alias("done"), text.alias("text"), n.alias("n"))

    def visit(at: Column, part: Column) -> Column:
        number = at["n"] + 1
        mark = F.concat(F.lit("<"), part["kind"], F.lit(":"), number.cast("string"), F.lit(">"))
        placed = state(F.concat(at["done"], escaped(at["text"]), mark), F.lit(""), number)
        return F.when(part["kind"].isin(*PLACED), placed).otherwise(state(at["done"], F.concat(at["text"], F.coalesce(part["text"], F.lit(""))), at["n"]))

    return F.aggregate(parts, state(F.lit(""), F.lit(""), F.lit(0)), visit, lambda at: F.concat(at["done"], escaped(at["text"])))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end, attachments) of rows (conv_id, turn, role, parts)."""
    role = escaped(F.coalesce(F.col("role"), F.lit("")))
    head = F.concat(F.lit("<s>[ROLE]"), role, F.lit("[/ROLE]"))
    others = F.filter(F.coalesce("parts", F.array().cast(PARTS)), lambda p: p["kind"].isin(*PLACED))
    attachments = F.transform(others, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    made = turns.select("conv_id", "turn", F.col("role").eqNullSafe(LEARNED).alias("learned"), head.alias("head"), flattened(F.col("parts")).alias("content"), attachments.alias("attachments"))
    begin = F.length("head")
    end = begin + F.length("content")
    return made.select("conv_id", "turn", F.concat("head", "content", F.lit("</s>")).alias("segment"), F.when(F.col("learned"), begin).alias("loss_start"), F.when(F.col("learned"), end).alias("loss_end"), "attachments")


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its segments as a stream in order of turn: a conversation of any length needs no more memory than one turn."""
    kind = shared.kind_of(segments, "conv_id")

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type = None

        def rows():
            nonlocal conv_type
            now, state = None, None
            for batch in batches:
                conv_type = batch.schema.field(0).type
                for conv, segment, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if state is None or conv != now:
                        if state is not None:
                            yield closed(now, state)
                        now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, content in SEGMENT.findall(segment):
                        state[0] += 1
                        state[1].update(f"{unescaped(role)}\n{unescaped(content)}\n".encode())
                    if start is not None:
                        learned = unescaped(segment[start:end])
                        state[2] += len(learned)
                        state[3].update(learned.encode())
                    state[4] += len(segment)
            if state is not None:
                yield closed(now, state)

        def closed(conv, state):
            return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        source = rows()
        first = next(source, None)
        if first is not None:
            from itertools import chain

            yield from shared.arrow_rows(chain([first], source), {"conv_id": conv_type, "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()})

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return dealt.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def text_parts(text: Column) -> Column:
    """One text part."""
    none = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, LEARNED, hard)], rows.schema)
    return read_back(formatted(rows.unionByName(extra).withColumn("parts", text_parts(F.col("text")))))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length('<s>[ROLE][/ROLE]</s>') + length(role) + length(text)
    + len(regexp_extract_all(text, '[<\[]\\*(?:s>|/s>|ROLE\]|/ROLE\]|INST\]|/INST\]|image:|audio:|document:)')) AS size
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
