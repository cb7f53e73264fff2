"""Steps that are bounded for long tracks and many requests, against plain versions."""

import numpy as np
import pytest

from trackloom.functions import kernels as k
from trackloom.operators import relational, sequences, simplify

R = np.random.default_rng(11)


@pytest.mark.parametrize("size", [1, 7, 65536])
def test_gaps_across_chunks(spark, size):
    bad = np.where(R.random(200) < 0.8, R.choice([np.nan, np.inf, -np.inf], 200), R.random(200))
    tracks = {"a": bad, "none": np.full(20, np.nan), "ends": np.r_[[np.nan] * 30, 1.0, 3.0, [np.inf] * 30], "one": np.array([np.nan, 2.0])}
    rows = [(key, i, None if i % 5 == 0 and not np.isfinite(v) else float(v)) for key, x in tracks.items() for i, v in enumerate(x)]
    got = sequences.linear_fill(spark.createDataFrame(rows, "video_id string, frame long, pos double"), "pos", size=size).orderBy("frame").collect()
    for key, x in tracks.items():
        assert np.allclose([r.pos for r in got if r.video_id == key], k.fill_bad(x), atol=1e-12)


def test_first_cover_by_trying_all():
    for n, m in ((0, 5), (1, 40), (7, 60), (33, 200)):
        a, lo = R.integers(0, 50, n), R.integers(0, 60, m)
        b, hi = a + R.integers(1, 30, n), lo + R.integers(1, 12, m)
        wanted = [next((i for i in range(n) if a[i] <= p and b[i] >= q), -1) for p, q in zip(lo, hi, strict=True)]
        assert relational.first_cover(lo, hi, a, b).tolist() == wanted


def test_covers_of_all_lengths(spark):
    """Clips from one frame to a million, starts below 0, equal spans, requests given twice."""
    lo = R.integers(-40_000, 1_500_000, 300)
    clips = [("x" if i % 3 else "y", f"p{R.integers(0, 90)}", int(a), int(a + 2 ** R.integers(0, 21))) for i, a in enumerate(lo - R.integers(0, 3000, 300))]
    clips += [("x", "zero", 5, 5), (None, "none", 0, 1 << 40)]
    asked = [("x" if i % 2 else "y", int(a), int(a + R.integers(1, 400))) for i, a in enumerate(lo)] * 2 + [(None, 1, 2), ("x", None, 3)]
    got = relational.smallest_cover(spark.createDataFrame(asked, "id string, lo long, hi long"), spark.createDataFrame(clips, "id string, path string, clip_lo long, clip_hi long"), "id")
    wanted = set()
    for key, p, q in asked:
        fits = [(d - c, path) for k_, path, c, d in clips if key is not None and p is not None and k_ == key and c <= p and d >= q]
        wanted |= {(key, p, q, min(fits)[1], min(fits)[0])} if fits else set()
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(wanted) and set(rows) == wanted


def _noise(n, seed):
    r = np.random.default_rng(seed)
    return {"noise": r.integers(0, 101, n).astype(float), "burst": np.clip(np.rint(r.exponential(50, n)), 0, 100), "wave": np.rint(50 + 45 * np.sin(np.arange(n) / 9) + r.random(n) * 8), "plateaus": np.repeat(r.integers(0, 101, n // 5 + 1), 5)[:n].astype(float)}


@pytest.mark.parametrize(("size", "margin"), [(300, 32), (100, 3), (25, 2)])
def test_refinement_without_calm_stretches_goes_in_pieces(spark, monkeypatch, size, margin):
    """Noise has no calm stretch; a piece stays near a chunk unless its neighbours disagree, and the knots are those of the whole."""
    x = _noise(1500, size)
    dense = spark.createDataFrame([(key, i, float(v)) for key, y in x.items() for i, v in enumerate(y)], "video_id string, frame long, y double")
    starts = {key: np.unique(np.r_[0, len(y) - 1, k.turning_points(y, 30.0, 10.0)]) for key, y in x.items()}
    first = spark.createDataFrame([(key, int(f)) for key, fs in starts.items() for f in fs], "video_id string, frame long")
    rounds, deal = [], simplify._refined_pieces
    monkeypatch.setattr(simplify, "_refined_pieces", lambda own, spans, cuts, *rest: rounds.append(cuts) or deal(own, spans, cuts, *rest))
    got = simplify.refined(dense, first, size=size, margin=margin).collect()
    for key, y in x.items():
        assert sorted(r.frame for r in got if r.video_id == key) == k.refine(y, starts[key]).tolist()
    if margin == 32:
        assert len(rounds) == 1 and rounds[0].count() == 4 * 1500 // size


@pytest.mark.parametrize("size", [40, 200])
def test_device_pass_in_pieces(spark, size):
    x = _noise(1500, size + 1)
    knots = {key: np.flatnonzero(np.random.default_rng(1).random(1500) < 0.5) for key in x}
    rows = spark.createDataFrame([(key, int(f), float(x[key][f])) for key, fs in knots.items() for f in fs], "video_id string, frame long, y double")
    parts = {}
    for r in simplify.device_pieces(rows, 30.0, size).collect():
        parts.setdefault((r.video_id, r.piece), []).append((r.frame, r.home))
    assert max(len(v) for (key, _), v in parts.items() if key == "noise") < 3 * size
    for key, fs in knots.items():
        got = []
        for (name, _), part in parts.items():
            kept = k.device_points(x[key], np.array(sorted(f for f, _ in part)), 30.0) if name == key else []
            got += [f for f, home in part if home and f in set(np.asarray(kept).tolist())]
        assert sorted(got) == k.device_points(x[key], fs, 30.0).tolist()


def test_scripts_as_columns_are_those_action_by_action(spark):
    from trackloom.sources import layout, scripts

    for n in (0, 1, 127, 128, 20_000):
        rows = [(float(np.float32(i / 30)), int(i % 101)) for i in range(n)]
        data = layout.encode_script(rows, "a/b", "ü")
        assert layout.encode_actions(np.array([s for s, _ in rows]), np.array([p for _, p in rows]), "a/b", "ü") == data
        assert list(zip(*(c.tolist() for c in layout.decode_actions(data)), strict=True)) == rows
        for cut in (data[:3], data[: len(data) // 2], data[:-1]):
            with pytest.raises((ValueError, layout.struct.error)):
                layout.decode_actions(cut)
    odd = layout.block(layout.record(layout.listed(layout.block(layout.record(layout.number("f"), layout.number("h"), layout.number("I")))), layout.TEXT, layout.TEXT, layout.number("B")))
    assert [c.tolist() for c in layout.decode_actions(odd.write(([(1.0, 5, 0)], "", "", 1)))] == [[1.0], [5]]
    frame = spark.createDataFrame([(key, int(1000 * i / 30), i % 120 - 9) for key in "abc" for i in range(3000)], "video_id string, at long, pos int")
    packed = scripts.packed_scripts(frame)
    for r in packed.collect():
        assert bytes(r.data) == layout.encode_script([(float(np.float32(int(1000 * i / 30) / 1000)), min(max(i % 120 - 9, 0), 100)) for i in range(3000)], f"{r.video_id}.funscript", r.video_id)
    assert scripts.unpacked_scripts(packed).count() == 9000
