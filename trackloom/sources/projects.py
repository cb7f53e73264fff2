"""Project files: the state of a new project with its scripts, as a nested record, as JSON and as CBOR."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.schema import KEY
from trackloom.sources import cbor, layout

# The record of a new project; what is not given below starts empty.
TEXTS = ["script_url", "video_url", "description", "license", "notes", "topic_url", "topic_creator", "topic_date"]
LISTS = ["tags", "performers", "topic_tags"]


def new_states(media: DataFrame, actions: DataFrame) -> DataFrame:
    """(video_id, json): the state of a new project for each medium (video_id, title, creator, media_path); its duration is the last action's time (video_id, at)."""
    last = actions.groupBy(KEY).agg(F.max("at").alias("last"))
    duration = F.coalesce(F.col("last") / 1000.0, F.lit(0.0)).alias("duration")
    empty = F.array().cast("array<string>")
    metadata = F.struct(F.lit("basic").alias("type"), F.col("title"), F.coalesce("creator", F.lit("")).alias("creator"), *[F.lit("").alias(c) for c in TEXTS], *[empty.alias(c) for c in LISTS], duration)
    state = F.struct(metadata.alias("metadata"), F.col("media_path").alias("relativeMediaPath"), F.lit(0.0).alias("activeTimer"), F.lit(0.0).alias("lastPlayerPosition"), F.lit(0).alias("activeScriptIdx"), F.lit(False).alias("nudgeMetadata"), F.struct(F.lit("").alias("$bytes")).alias("binaryFunscriptData"))
    return media.join(last, KEY, "left").select(KEY, F.to_json(state).alias("json"))


def project_files(states: DataFrame, packed: DataFrame) -> DataFrame:
    """(video_id, data): CBOR of the states (video_id, json) with the binary scripts (video_id, data) of each, in order of their bytes, inside."""
    listed = packed.groupBy(KEY).agg(F.sort_array(F.collect_list("data")).alias("scripts"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = []
            for text, scripts in zip(part["json"], part["scripts"], strict=True):
                state = cbor.decoded(cbor.from_json(text))
                state["binaryFunscriptData"] = layout.encode_project([bytes(s) for s in scripts] if scripts is not None else [])
                made.append(cbor.encoded(state))
            yield pd.DataFrame({KEY: part[KEY], "data": made})

    return states.join(listed, KEY, "left").mapInPandas(run, f"{KEY} string, data binary")


def opened(files: DataFrame) -> DataFrame:
    """(video_id, json, scripts, error) of CBOR projects (video_id, data): the state without its scripts, these as binary scripts; a file that can't be read has an error alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, data in zip(part[KEY], part["data"], strict=True):
                try:
                    state = cbor.decoded(bytes(data))
                    scripts = layout.decode_project(state.pop("binaryFunscriptData", b""))
                    out.append((key, cbor.as_json(cbor.encoded(state)), scripts, None))
                except (ValueError, AttributeError) as e:
                    out.append((key, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[KEY, "json", "scripts", "error"])

    return files.select(KEY, "data").mapInPandas(run, f"{KEY} string, json string, scripts array<binary>, error string")
