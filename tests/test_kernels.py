"""Order-bound kernels against plain versions and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.functions import kernels as k
from trackloom.sources import layout as scripts

TRACK = st.lists(st.integers(0, 20).map(lambda v: v / 20), min_size=1, max_size=60).map(np.array)


@settings(max_examples=60, deadline=None)
@given(TRACK)
def test_local_maxima_are_plateau_middles(x):
    wanted = []
    i = 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            wanted.append((i + j) // 2)
        i = j + 1
    assert k.local_maxima(x).tolist() == wanted


@settings(max_examples=60, deadline=None)
@given(TRACK, st.integers(1, 6))
def test_peaks_keep_their_distance(x, gap):
    peaks = k.find_peaks(x, gap)
    assert all(b - a >= gap for a, b in zip(peaks, peaks[1:]))
    assert set(peaks) <= set(k.local_maxima(x))


def test_prominence_by_hand():
    x = np.array([0, 3, 2, 5, 0, 1, 0.5, 4, 0], float)
    assert k.find_peaks(x, 1, 1.0).tolist() == [1, 3, 7]
    assert k.find_peaks(x, 1, 0.4).tolist() == [1, 3, 5, 7]


def test_savgol_keeps_parabolas_to_the_ends():
    t = np.arange(40.0)
    x = 0.3 * t * t - 2 * t + 1
    assert np.allclose(k.savgol(x, 7), x)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 6, 7, 8, 31, 32])
def test_short_tracks(n):
    x = np.linspace(0, 1, n)
    assert len(k.lowpass(x, 30)) == n and len(k.smooth(x, 30, 0.45)) == n
    assert k.simplified(100 * x, 30).tolist() == sorted(set(k.simplified(100 * x, 30).tolist()))
    if n:
        assert len(k.postprocessed(x, 30)[0]) == n


def test_lowpass_passes_slow_and_stops_fast():
    t = np.arange(600) / 60
    slow, fast = np.sin(2 * np.pi * t), np.sin(2 * np.pi * 25 * t)
    assert np.abs(k.lowpass(slow, 60) - slow)[20:-20].max() < 0.02
    assert np.abs(k.lowpass(fast, 60))[20:-20].max() < 0.02


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=8, max_size=80))
def test_refine_meets_its_error(values):
    y = np.array(values, float)
    knots = k.refine(y, np.array([0, len(y) - 1]), 3.0)
    assert np.abs(k.pchip(knots, y[knots], np.arange(len(y))) - y).max() <= 3.0 + 1e-9


def test_pchip_is_monotone_and_exact_at_knots():
    at, y = np.array([0, 3, 4, 9]), np.array([0.0, 5.0, 5.5, 20.0])
    v = k.pchip(at, y, np.linspace(0, 9, 91))
    assert (np.diff(v) >= -1e-9).all() and np.allclose(k.pchip(at, y, at.astype(float)), y)


def test_bad_samples():
    assert k.fill_bad([np.nan, 1, np.inf, 3, np.nan]).tolist() == [1, 1, 2, 3, 3]
    assert k.fill_bad([np.nan, np.nan]).tolist() == [0, 0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1e5, width=32), st.integers(0, 100)), max_size=200), st.text(max_size=200))
def test_scripts_round_trip(rows, path):
    one = scripts.encode_script(rows, path, "t")
    assert scripts.decode_script(one) == (rows, path, "t")
    assert scripts.decode_project(scripts.encode_project([one, one])) == [one, one]


def test_script_bytes_by_hand():
    action = bytes([12, 0, 0, 0]) + np.float32(1.5).tobytes() + bytes([50, 0, 0, 0])
    assert scripts.encode_script([(1.5, 50)], "a", "bc") == bytes([4 + 1 + 12 + 2 + 3 + 1, 0, 0, 0, 1]) + action + b"\x01a\x02bc\x01"
    for n, raw in ((5, [5]), (0x7F, [0x7F]), (0x80, [0x80, 0x80]), (0x1234, [0x92, 0x34]), (0x01234567, [0xC1, 0x23, 0x67, 0x45])):
        assert scripts.size_bytes(n) == bytes(raw) and scripts.read_size(bytes(raw), 0) == (n, len(raw))


def test_overrun_is_an_error():
    for cut in (1, 3, 8):
        with pytest.raises((ValueError, IndexError)):
            scripts.decode_script(scripts.encode_script([(1.0, 5)], "abc", "d")[:-cut])


def test_spans_end_at_prominent_turns_and_plateaus(spark):
    from trackloom.operators import per_track, sequences

    noisy = np.interp(np.arange(61), [0, 14, 16, 30, 45, 60], [0, 1, 1, 0, 0.9, 0.1]) + 0.01 * (np.arange(61) % 2) * (np.abs(np.arange(61) - 15) > 1)
    track = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(noisy)], "video_id string, frame long, pos double").withColumns({"spread": F.col("pos") * 0.1, "gap": F.col("pos") * 0.2})
    spans = {r.frame: r.span for r in per_track.turning_spans(track, 30.0).collect()}
    cuts = [f for f in range(1, 61) if spans[f] != spans[f - 1]]
    assert len(cuts) == 3 and all(abs(c - w) <= 1 for c, w in zip(cuts, (15, 30, 45)))
    got = sorted(sequences.confidence(track, lambda t: per_track.turning_spans(t, 30.0)).collect(), key=lambda r: r.frame)
    for r in got:
        same = [x for x in got if spans[x.frame] == spans[r.frame]]
        assert r.c3 == pytest.approx(min(np.median([x.c1 for x in same]), np.median([x.c2 for x in same])))


# slow, plain versions of the order-bound kernels

WAVE = st.tuples(st.integers(0, 10_000), st.sampled_from([1, 2, 3, 7, 8, 31, 32, 120, 400])).map(lambda a: _wave(*a))


def _wave(seed, n):
    r = np.random.default_rng(seed)
    x = 0.5 + 0.5 * np.sin(np.cumsum(r.uniform(0, 0.4, n))) * r.uniform(0.2, 1) + r.normal(0, 0.03, n) * (seed % 3)
    x[r.random(n) < 0.2] = 0.5
    return np.clip(np.round(x, 2), 0, 1)


def _curve(knots, y):
    """The monotone cubic by its textbook rules, knot by knot."""
    x, v = [int(k) for k in knots], [float(y[k]) for k in knots]
    h = [float(b - a) for a, b in zip(x, x[1:])]
    d = [(b - a) / w for a, b, w in zip(v, v[1:], h)]
    m = [0.0] * len(x)
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            a, b = h[i - 1] + 2 * h[i], 2 * h[i - 1] + h[i]
            m[i] = (a + b) / (b / d[i] + a / d[i - 1])
    for i, near, far in ((0, 0, 1), (-1, -1, -2)):
        if len(h) == 1:
            m[i] = d[0]
            continue
        s = ((2 * h[near] + h[far]) * d[near] - h[near] * d[far]) / (h[near] + h[far])
        m[i] = 0.0 if s * d[near] <= 0 else 3 * d[near] if d[near] * d[far] <= 0 and abs(s) > 3 * abs(d[near]) else s
    out = []
    for i in range(len(h)):
        for f in range(x[i], x[i + 1]):
            t = (f - x[i]) / h[i]
            r = 1 - t
            out.append(v[i] * (1 + 2 * t) * r * r + m[i] * h[i] * t * r * r + v[i + 1] * t * t * (3 - 2 * t) - m[i + 1] * h[i] * t * t * r)
    return np.array([*out, v[-1]])


@settings(max_examples=150, deadline=None)
@given(WAVE, st.integers(0, 3), st.sampled_from([None, None, 2, 5, 20]))
def test_refine_as_one_frame_at_a_time(x, seed, most):
    y = np.round(100 * x)
    start = np.unique(np.random.default_rng(seed).integers(0, len(y), seed * 4))
    knots = sorted({*start.tolist(), 0, len(y) - 1})
    while len(knots) > 1 and (most is None or len(knots) < most):
        error = np.abs(_curve(knots, y) - y)
        error[knots] = 0
        if error.max() <= 3:
            break
        knots = sorted({*knots, int(error.argmax())})
    assert k.refine(y, start, 3.0, most).tolist() == knots


@settings(max_examples=80, deadline=None)
@given(WAVE, st.integers(1, 6))
def test_device_points_by_the_rules(x, stride):
    y, points = np.round(100 * x), list(dict.fromkeys([*range(0, len(x), stride), len(x) - 1]))
    left = list(points)
    while True:  # the first inner point that neither neighbour moves by 5 goes, until there is none
        small = [i for i in range(1, len(left) - 1) if abs(y[left[i]] - y[left[i - 1]]) < 5 and abs(y[left[i]] - y[left[i + 1]]) < 5]
        if not small:
            break
        del left[small[0]]
    kept, gap = k.device_points(y, np.array(points), 60).tolist(), 55 * 60 / 1000
    assert set(kept) <= set(left) and kept[0] == left[0] and kept[-1] == left[-1]
    # pair by pair: the first gap and the one before the last point may be short; a point that went stood too near behind one that moves more, or gave way to one that moves no less
    assert all(b - a >= gap for a, b in zip(kept[1:-2], kept[2:-1]))
    for p, o, after in zip([None, *kept], kept, kept[1:]):
        for q in (q for q in left if o < q < after):
            near = p is not None and q - o < gap and abs(y[q] - y[p]) < abs(y[o] - y[p])
            assert near or abs(y[q] - y[o]) <= abs(y[after] - y[o])


@settings(max_examples=80, deadline=None)
@given(WAVE)
def test_cycles_left_to_right(x):
    troughs = k.find_peaks(-x, 2)
    out, inside, made = k.normalised_cycles(x, x, troughs, 30.0)
    wanted, mask, count = list(x), set(), 0
    for s, e in zip(troughs, troughs[1:]):
        part = wanted[s : e + 1]
        if 2 <= e - s <= 60 and max(x[s : e + 1]) - min(x[s : e + 1]) >= 0.3 and max(part) - min(part) > 1e-6:
            wanted[s : e + 1] = [(v - min(part)) / (max(part) - min(part)) for v in part]
            mask |= set(range(s, e + 1))
            count += 1
    assert np.allclose(out, wanted) and set(np.flatnonzero(inside)) == mask and made == count


@settings(max_examples=80, deadline=None)
@given(WAVE, st.integers(0, 5))
def test_slopes_frame_by_frame(x, seed):
    exclude = np.random.default_rng(seed).random(len(x)) < 0.1 * seed
    got = k.gradient_segments(x, 10.0, exclude)
    n = len(x)
    g = [0.0] * n if n < 2 else [x[1] - x[0], *((x[i + 1] - x[i - 1]) / 2 for i in range(1, n - 1)), x[-1] - x[-2]]
    free = [abs(v) for v, out in zip(g, exclude) if not out and v != 0]
    found = []
    if n >= 3 and free:
        low = max(0.00075, np.percentile(free, 25))
        high = max(np.percentile(free, 90), low)
        frames = [i for i in range(n) if not exclude[i] and low <= abs(g[i]) <= high]
        for i in frames:
            if found and i - found[-1][-1] - 1 <= 2:
                found[-1].append(i)
            else:
                found.append([i])
        found = [(f[0], f[-1] + 1) for f in found]
        sums = [[np.sign(v) for v in g[s:e] if abs(v) >= low] for s, e in found]
        found = [(s, e) for (s, e), z in zip(found, sums) if e - s >= 6 and z and abs(sum(z)) >= 0.65 * len(z) - 1e-9 and max(x[s:e]) - min(x[s:e]) >= 0.08]
    assert list(zip(got.starts.tolist(), got.ends.tolist())) == found


def test_one_pass_counts_and_clips():
    x = np.concatenate([0.5 + 0.4 * np.sin(np.arange(300) / 6), np.linspace(0.2, 0.6, 120), np.full(60, 0.6)])
    out, counts = k.postprocessed(x, 30.0)
    assert counts["samples"] == 480 and counts["cycles"] >= 5 and counts["slopes"] >= 1 and 0 <= out.min() and out.max() <= 1
    assert out[60:240].min() == 0 and out[60:240].max() == 1 and np.ptp(out[320:400]) > 0.9


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 12])
def test_moving_average_is_cut_to_the_track(spark, n):
    from trackloom.operators import sequences

    x = np.arange(n) ** 2 / 7
    track = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "video_id string, frame long, pos double")
    means = sequences.by_length(track, 9, lambda t, short: t.withColumn("m", sequences.moving_average(F.col("pos"), short=short)))
    got = [r.m for r in sorted(means.collect(), key=lambda r: r.frame)]
    w = min(9, n)
    ones = np.ones(w)
    assert np.allclose(got, np.convolve(x, ones, "same") / np.convolve(np.ones(n), ones, "same") if w > 1 else x)
