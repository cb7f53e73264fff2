"""Scalar expressions: quantising, boxes, fingerprints and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised(pos: Column) -> Column:
    """0 to 100, half to even."""
    return F.least(F.greatest(F.rint(pos * 100), F.lit(0.0)), F.lit(100.0)).cast("int")


def at_ms(seconds: Column) -> Column:
    return F.rint(seconds * 1000).cast("long")


def crop_box(text: Column) -> Column:
    """x1, y1, x2, y2 of "x1,y1,x2,y2", or null where it isn't a proper box within 0 to 1."""
    v = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    get = lambda i: F.get(v, F.lit(i))
    fits = (F.size(v) == 4) & (get(0) >= 0) & (get(0) < get(2)) & (get(2) <= 1) & (get(1) >= 0) & (get(1) < get(3)) & (get(3) <= 1)
    return F.when(fits, F.struct(*(get(i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2")))))


# The default crop, the centre of the lower part.
CROP_BOX = (1 / 6, 1 / 3, 5 / 6, 1.0)


def crop_tag(box: Column) -> Column:
    """`crop` for the default crop or without a box, `full` for the whole frame, else the box in ten-thousandths."""
    names = ("x1", "y1", "x2", "y2")
    equals = lambda values: F.array(*(box[n] for n in names)) == F.array(*map(F.lit, values))
    part = lambda n: F.lpad(F.rint(box[n] * 10000).cast("long").cast("string"), 5, "0")
    return F.when(box.isNull() | equals(CROP_BOX), "crop").when(equals((0.0, 0.0, 1.0, 1.0)), "full").otherwise(F.concat(F.lit("box"), F.concat_ws("-", *map(part, ("x1", "y1", "x2", "y2")))))


def crop_pixels(box: Column, width: Column, height: Column) -> Column:
    """Even pixel edges; a bottom of 1 is the whole height."""
    even = lambda v: F.rint(v).cast("long").bitwiseAND(F.lit(-2))
    return F.struct(
        even(box["x1"] * width).alias("left"), even(box["y1"] * height).alias("top"),
        F.least(even(box["x2"] * width), width).cast("long").alias("right"),
        F.when(box["y2"] >= 1, height).otherwise(even(box["y2"] * height)).cast("long").alias("bottom"),
    )


def fingerprint(*parts: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, size)


def safe_name(name: Column, size: int = 80) -> Column:
    return F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), 1, size)


def duration_text(seconds: Column) -> Column:
    s = F.rint(seconds).cast("long")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %02ds", minutes, s % 60)).otherwise(F.format_string("%dh %02dm", hours, minutes % 60))


def frame_window(start_s: Column, length_s: Column, fps: Column, total: Column) -> Column:
    start = F.rint(start_s * fps).cast("long")
    return F.struct(start.alias("start"), F.least(total, start + F.rint(length_s * fps).cast("long")).alias("end"))


def pooled_tokens(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0), lambda a, k: a + k * k)


def batch_windows(window: Column, height: Column, width: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(F.lit(128.0) / window * (224.0 * 224.0) / (height * width)).cast("int"))


def decode_batch(frame_bytes: Column) -> Column:
    """How many frames of that size fit into 2 GiB, 1 to 64; 16 if unknown."""
    return F.coalesce(F.least(F.greatest(F.floor(F.lit(2**31) / frame_bytes), F.lit(1)), F.lit(64)), F.lit(16)).cast("int")


def window_stride(stride: Column, crop: Column) -> Column:
    return F.least(F.greatest(F.coalesce(F.nullif(stride, F.lit(0)), F.floor(crop / 2).cast("int")), F.lit(1)), crop)


def frame_rate(text: Column, average: Column) -> Column:
    """"num/den", den 1 if absent; else the average rate, else 30."""
    p = F.split(text, "/")
    num, den = F.get(p, F.lit(0)).try_cast("double"), F.coalesce(F.get(p, F.lit(1)).try_cast("double"), F.lit(1.0))
    return F.coalesce(F.when((den != 0) & (num > 0), num / den), average, F.lit(30.0))


# Pooling layouts by their number of tokens.
LAYOUTS = {5: [1, 2], 14: [1, 2, 3], 54: [1, 2, 7]}


def pooling_of(tokens: Column) -> Column:
    """The pooling levels of a token count, null for a count no layout has."""
    found = F.lit(None).cast("array<int>")
    for count, levels in LAYOUTS.items():
        found = F.when(tokens == count, F.array(*map(F.lit, levels))).otherwise(found)
    return found


def adaptive_bounds(size: Column, parts: int, i: int) -> tuple[Column, Column]:
    """First row and end of part i of an adaptive pooling: parts overlap where they don't divide the size."""
    return F.floor(size * i / parts), F.ceil(size * (i + 1) / parts)


def backbone_print(name: Column, revision: Column, size: Column, modified: Column, window: Column) -> Column:
    """A model's identity: its name with its revision, else with its file's size and time, else alone; and the tag of a window that isn't the default."""
    whole = F.when(revision.isNotNull(), F.concat_ws("|", name, revision)).when(size.isNotNull(), F.concat_ws("|", name, size.cast("string"), modified.cast("long").cast("string"))).otherwise(name)
    return F.substring(F.sha2(F.concat(whole, F.coalesce(window, F.lit(""))), 256), 1, 12)


def model_hash(content: Column, config: Column) -> Column:
    """SHA-256 of a file's bytes and its configuration's JSON, whose keys stand in order."""
    return F.sha2(F.concat(content, config.cast("binary")), 256)


def cache_key(name: Column, print_: Column, start: Column, end: Column, crop: Column, layout: Column) -> Column:
    """All that changes a cached result's bytes, as one file name."""
    return F.concat(safe_name(name), F.format_string("__%s_f%06d-%06d_%s_p%d", print_, start, end, crop, layout))


def clip_offset(frame: Column, first: Column) -> Column:
    """Where a source frame stands in a clip; null before its first."""
    return F.when(frame >= first, frame - first)


def relative_path(path: Column, base: Column) -> Column:
    """`path` as seen from the folder `base`, both absolute."""
    a, b = (F.filter(F.split(c, "/"), lambda x: x != "") for c in (path, base))
    both = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda n: F.coalesce(F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n), F.lit(False)))
    same = F.size(F.filter(both, lambda x: x))
    up = F.array_repeat(F.lit(".."), F.size(b) - same)
    rest = F.slice(a, same + 1, F.greatest(F.size(a) - same, F.lit(0)))
    found = F.array_join(F.concat(up, rest), "/")
    return F.when(found == "", ".").otherwise(found)


# The families that take interleaved frames, and the token counts of the pooling layouts.
INTERLEAVING, POOLED = ["vjepa21"], [5, 14, 54]


def head_status(frames_per_slot: Column, declared: Column, family: Column, tokens: Column) -> Column:
    """The first thing that head, data and backbone do not agree on, or ok: a head of one frame a slot takes interleaved frames, as its data must say (null: says nothing) and its family allow; its token count names a pooling layout."""
    interleaves = frames_per_slot == 1
    return (
        F.when(~frames_per_slot.isin(1, 2), "frames_per_slot")
        .when(F.coalesce(declared != interleaves, F.lit(False)), "interleave_input")
        .when(interleaves & ~family.isin(*INTERLEAVING), "family")
        .when(~tokens.isin(*POOLED), "pooling")
        .otherwise("ok")
    )
