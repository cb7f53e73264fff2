"""Operators that cross chunks against plain versions of one whole track, with chunks of a few frames."""

import math

import numpy as np
import pytest

from trackloom.functions import kernels as k
from trackloom.operators import cycles, filters, per_track, turns

R = np.random.default_rng(5)


def tracks_of(spark, arrays):
    rows = [(key, i, float(v)) for key, x in arrays.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "video_id string, frame long, pos double")


def by_track(df, *columns):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.frame):
        out.setdefault(r.video_id, []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


def plain_peaks(x, distance, prominence):
    n, found, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    stay = list(found)
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if p in stay:
            stay = [q for q in stay if q == p or abs(q - p) >= distance]
    if prominence is None:
        return stay
    out = []
    for p in stay:
        left, right = p, p
        while left > 0 and x[left - 1] <= x[p]:
            left -= 1
        while right < n - 1 and x[right + 1] <= x[p]:
            right += 1
        if x[p] - max(min(x[left : p + 1]), min(x[p : right + 1])) >= prominence:
            out.append(p)
    return out


def steps(n, levels, scale):
    return R.integers(0, levels, n) / scale


PEAKS = {str(n): steps(n, 2 + n % 9, [3.0, 7.0, 10.0][n % 3]) for n in (1, 2, 3, 4, 9, 17, 33, 64, 80)} | {
    "ramp": np.arange(90) % 2 * 0.1 + np.arange(90) * 0.01, "hold": np.r_[np.zeros(20), np.ones(40), np.zeros(9)], "fall": -np.arange(70.0), "flat": np.full(50, 0.5)
}


@pytest.mark.parametrize(("size", "distance", "prominence"), [(1, 5, None), (7, 4, 0.1), (16, 3, 1 / 3), (1000, 4, 0.3)])
def test_peaks_across_chunks(spark, monkeypatch, size, distance, prominence):
    monkeypatch.setattr(turns, "LEAST_MARGIN", 1)
    monkeypatch.setattr(turns, "MARGIN_DISTANCES", 1)
    got = by_track(turns.turns(tracks_of(spark, PEAKS), 10.0, prominence, distance / 10, signs=(1,), single=False, size=size), "frame")
    for key, x in PEAKS.items():
        wanted = plain_peaks(x, distance, prominence)
        assert got.get(key, []) == wanted, key
        assert k.find_peaks(x, distance, prominence).tolist() == wanted


def test_spans_across_chunks(spark):
    got = by_track(turns.numbered(tracks_of(spark, PEAKS), tracks_of(spark, PEAKS).where("frame % 7 = 3").select("video_id", "frame"), size=5), "span")
    assert all(got[key] == [(f + 4) // 7 for f in range(len(x))] for key, x in PEAKS.items())


def plain_lowpass(x, fps, cutoff=8.0):
    if len(x) <= 6:
        return x
    w = math.tan(math.pi * cutoff / fps)
    scale = 1 + math.sqrt(2) * w + w * w
    b0, a1, a2 = w * w / scale, 2 * (w * w - 1) / scale, (1 - math.sqrt(2) * w + w * w) / scale
    pad = min(9, len(x) - 1)

    def once(values):
        # from rest at the first value
        u1 = u2 = y1 = y2 = values[0]
        out = []
        for u in values:
            y = b0 * (u + 2 * u1 + u2) - a1 * y1 - a2 * y2
            u1, u2, y1, y2 = u, u1, y, y1
            out.append(y)
        return out

    wide = [2 * x[0] - v for v in x[pad:0:-1]] + list(x) + [2 * x[-1] - v for v in x[-2 : -pad - 2 : -1]]
    return np.array(once(once(wide)[::-1])[::-1][pad : pad + len(x)])


NOISE = {str(n): R.random(n) for n in (1, 3, 5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 16, 17, 31, 64, 150)}


@pytest.mark.parametrize("size", [7, 16, 1000])
def test_lowpass_across_chunks(spark, size):
    x = NOISE | {"gaps": np.where(R.random(120) < 0.3, np.nan, R.random(120)), "none": np.full(40, np.inf), "few": np.r_[np.full(30, np.nan), R.random(3), np.full(40, -np.inf)]}
    got = by_track(filters.lowpass(tracks_of(spark, x), 30.0, size=size), "value")
    for key, v in x.items():
        assert np.allclose(got[key], plain_lowpass(k.fill_bad(v), 30.0), atol=1e-9, rtol=0), key
        assert np.allclose(k.lowpass(k.fill_bad(v), 30.0), plain_lowpass(k.fill_bad(v), 30.0), atol=1e-9, rtol=0)


def test_smoothing_across_chunks(spark):
    t = tracks_of(spark, NOISE)
    even, shrunk, kept = (by_track(f, "value") for f in (filters.gaussian(t, 1.3, size=16), filters.polynomial(t, 13, size=16), filters.polynomial(t, 13, shrink=False, size=16)))
    weights = np.exp(-0.5 * (np.arange(-5, 6) / 1.3) ** 2)
    for key, x in NOISE.items():
        n = len(x)
        near = [[x[min(max(i + j, 0), n - 1)] for j in range(-5, 6)] for i in range(n)]
        assert np.allclose(even[key], near @ weights / weights.sum())
        for window, got in ((13 if n > 13 else n - 1 + n % 2, shrunk), (13 if n > 13 else 0, kept)):
            wanted = list(x)
            for i in range(n if window >= 5 else 0):
                start = min(max(i - window // 2, 0), n - window)
                wanted[i] = np.polyval(np.polyfit(np.arange(window), x[start : start + window], 2), i - start)
            assert np.allclose(got[key], wanted), (key, window)


def test_cycles_across_chunks(spark):
    waves = {str(s): np.round(np.clip(0.5 + 0.5 * np.sin(np.cumsum(R.uniform(0, 0.5, 150))) * R.uniform(0.3, 1) + R.normal(0, 0.02, 150), 0, 1), 2) for s in range(6)} | {"flat": np.zeros(30), "one": np.ones(1)}
    at = {key: k.find_peaks(-x, 2) for key, x in waves.items()}
    troughs = spark.createDataFrame([(key, int(f)) for key, f in ((key, f) for key, fs in at.items() for f in fs)], "video_id string, frame long")
    got = by_track(cycles.normalised(tracks_of(spark, waves), troughs, 30.0, size=16), "value", "inside")
    for key, x in waves.items():
        wanted, inside, _ = k.normalised_cycles(x, x, at[key], 30.0)
        assert np.allclose([v for v, _ in got[key]], wanted) and [m for _, m in got[key]] == inside.tolist()


def test_chunked_postprocessing_blends_its_chunks(spark):
    x, fps, chunk, overlap = np.clip(0.5 + 0.45 * np.sin(np.cumsum(R.uniform(0, 0.4, 400))), 0, 1), 10.0, 120, 20
    got = by_track(per_track.postprocessed(tracks_of(spark, {"a": x, "b": x[:100]}), fps, chunk_s=12.0, overlap_s=2.0), "value")
    total, weight, start = np.zeros(400), np.zeros(400), 0
    while True:
        end = min(start + chunk, 400)
        w = np.ones(end - start)
        ramp = np.arange(1, overlap + 1) / (overlap + 1)
        if start:
            w[:overlap] *= ramp[: len(w)]
        if end < 400:
            w[-overlap:] *= ramp[::-1]
        total[start:end] += w * k.postprocessed(x[start:end], fps)[0]
        weight[start:end] += w
        if end == 400:
            break
        start += chunk - overlap
    assert np.allclose(got["a"], np.clip(total / weight, 0, 1))
    assert np.allclose(got["b"], k.postprocessed(x[:100], fps)[0])


def test_projected_slots_number_by_number(spark):
    from trackloom.operators.projection import Projector, projected

    p = Projector(R.normal(size=(3, 10)), R.normal(size=3), R.normal(size=3), R.normal(size=3), R.normal(size=(5, 2)))
    x = R.normal(size=(4, 5, 2))
    rows = [("a", s, t, [float(v) for v in x[s, t]]) for s in range(4) for t in (3, 0, 4, 1, 2)]
    frame = spark.createDataFrame(rows, "video_id string, frame long, token int, e array<double>")
    got = by_track(projected(frame, p), "e")["a"]
    for s in range(4):
        z = [sum(p.weight[m, 2 * t + d] * (x[s, t, d] - p.constant[t, d]) for t in range(5) for d in range(2)) + p.bias[m] for m in range(3)]
        mean = sum(z) / 3
        dev = math.sqrt(sum((v - mean) ** 2 for v in z) / 3 + 1e-5)
        z = [(v - mean) / dev * p.scale[m] + p.shift[m] for m, v in enumerate(z)]
        assert np.allclose(got[s], [v * (1 + math.erf(v / math.sqrt(2))) / 2 for v in z])
    with pytest.raises(Exception, match="has not 5 tokens"):
        projected(frame.where("token < 4 or frame < 3"), p).collect()


@pytest.mark.parametrize("size", [8, 32, 1000])
def test_keyframes_in_pieces(spark, size):
    from trackloom.operators import simplify

    r = np.random.default_rng(size)
    hold = np.r_[np.linspace(0, 1, 30), np.full(40, 1.0), np.linspace(1, 0.2, 25), np.full(3, 0.2), r.random(40)]
    x = {"hold": hold, "flat": np.full(60, 0.5), "wave": 0.5 + 0.45 * np.sin(np.arange(150) / 5) + 0.02 * r.random(150), "steps": np.repeat(r.random(20), 5)} | {str(n): np.round(r.random(n), 2) for n in (1, 2, 3, 7, 8, 9, 40, 120)}
    x["calm"] = np.repeat([0.1, 0.9], 30)
    got = by_track(simplify.keyframes(tracks_of(spark, x), 30.0, size=size), "frame", "dense")
    for key, v in x.items():
        y = np.clip(np.rint(100 * v), 0, 100)
        kept = k.simplified(y, 30.0)
        assert got[key] == [(int(f), float(y[f])) for f in kept], key


def test_knots_of_pieces_are_those_of_the_whole(spark):
    from trackloom.operators import simplify

    r = np.random.default_rng(9)
    x = {str(i): np.repeat(r.integers(0, 101, 60), r.integers(1, 6, 60))[:150].astype(float) for i in range(8)}
    starts = {key: np.unique(np.r_[0, len(v) - 1, r.integers(0, len(v), 40)]) for key, v in x.items()}
    dense = tracks_of(spark, x).withColumnRenamed("pos", "y")
    first = spark.createDataFrame([(key, int(f)) for key, fs in starts.items() for f in fs], "video_id string, frame long")
    for size in (1, 4, 25):
        got = by_track(simplify.refined(dense, first, size=size), "frame")
        assert all(got[key] == k.refine(v, starts[key]).tolist() for key, v in x.items())
