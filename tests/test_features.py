import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paroxys.functions import bandstats, wavelet
from paroxys.operators import audit, augment, features


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 5, int(i % 4 == 0), c, rng.normal(size=128).tolist()) for i in range(20) for c in range(2)]
    return spark.createDataFrame(rows, "window_id bigint, subject int, y int, ch int, x array<double>")


def stacked(df):
    rows = df.orderBy("window_id", "ch").collect()
    return np.array([r["x"] for r in rows])


@pytest.mark.parametrize("n", [64, 65, 101, 1024])
def test_perfect_reconstruction(n):
    x = np.random.default_rng(0).normal(size=(3, n))
    back = wavelet.recompose(wavelet.decompose(x, 4))[:, :n]
    np.testing.assert_allclose(back, x, atol=1e-10)


def test_expression_equals_kernel(spark, vectors):
    rows = features.dwt_level(vectors).orderBy("window_id", "ch").collect()
    low, high = wavelet.analyse(stacked(vectors))
    np.testing.assert_allclose([r["approx"] for r in rows], low, atol=1e-12)
    np.testing.assert_allclose([r["detail"] for r in rows], high, atol=1e-12)


def test_subbands_sum_to_the_signal(vectors):
    rows = features.dwt_subbands(vectors, 4).collect()
    total = {}
    for r in rows:
        key = (r["window_id"], r["ch"])
        total[key] = total.get(key, 0) + np.array(r["x"])
        assert len(r["x"]) == 128
    want = {(r["window_id"], r["ch"]): r["x"] for r in vectors.collect()}
    for key, x in total.items():
        np.testing.assert_allclose(x, want[key], atol=1e-9)
    assert len(rows) == 40 * 5


def test_filter_keeps_slow_and_drops_fast(spark):
    t = np.arange(1024) / 256
    df = spark.createDataFrame(
        [(1, np.sin(2 * np.pi * 4 * t).tolist()), (2, np.sin(2 * np.pi * 80 * t).tolist())],
        "window_id bigint, x array<double>",
    )
    power = {r["window_id"]: np.mean(np.square(r["x"])) for r in features.dwt_filter_windows(df).collect()}
    assert power[1] > 0.4 and power[2] < 0.02


@pytest.mark.parametrize("level,keep,approx", [(5, (3, 4, 5), True), (3, (1,), False)])
def test_chunked_filter_equals_whole(spark, level, keep, approx):
    x = np.random.default_rng(2).normal(size=5003)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "user_id bigint, i bigint, value double")
    kept = features._kept(level, keep, approx)
    want = wavelet.keep_bands(x[None, :], level, kept)[0]
    got = features.dwt_filter(df, level, keep, approx, size=1024).orderBy("i").collect()
    np.testing.assert_allclose([r["value"] for r in got], want, atol=1e-10)


def naive_sample_entropy(ts):
    ts = np.asarray(ts)
    r, n = 0.2 * ts.std(ddof=1), len(ts)
    if r == 0:
        return 0.0

    def pairs(m):
        return sum(
            max(abs(ts[i + d] - ts[j + d]) for d in range(m)) <= r
            for i in range(n - m)
            for j in range(i + 1, n - m)
        )

    b, a = pairs(2), pairs(3)
    return 0.0 if b == 0 else (math.inf if a == 0 else -math.log(a / b))


def naive_permutation_entropy(ts):
    counts = {}
    for i in range(len(ts) - 2):
        shape = tuple(np.argsort(ts[i : i + 3], kind="stable"))
        counts[shape] = counts.get(shape, 0) + 1
    p = np.array(list(counts.values())) / sum(counts.values())
    return float(-(p * np.log2(p + 1e-12)).sum())


def naive_shannon(ts):
    p = np.histogram(ts, bins=32)[0]
    p = p[p > 0] / p.sum()
    return float(-(p * np.log2(p)).sum())


@pytest.mark.parametrize("n", [5, 40, 128])
def test_entropies(n):
    x = np.random.default_rng(n).normal(size=(6, n)).round(1)
    np.testing.assert_allclose(bandstats.sample_entropy(x), [naive_sample_entropy(r) for r in x])
    np.testing.assert_allclose(
        bandstats.sample_entropy(x, max_n=64), [naive_sample_entropy(r[:64]) for r in x]
    )
    np.testing.assert_allclose(bandstats.permutation_entropy(x), [naive_permutation_entropy(r) for r in x])
    smooth = np.random.default_rng(n).normal(size=(6, n))
    np.testing.assert_allclose(bandstats.shannon_entropy(smooth), [naive_shannon(r) for r in smooth])


def test_constant_band(spark):
    flat = np.ones((1, 64))
    stats = dict(zip(bandstats.STATS, bandstats.band_stats(flat)[0]))
    assert stats["std"] == 0 and stats["sample_entropy"] == 0 and stats["shannon_entropy"] == 0
    df = spark.createDataFrame([(1, 0, 0, 0, flat[0].tolist())], "window_id bigint, subject int, y int, ch int, x array<double>")
    vector = features.feature_vector(df, 2).first()["features"]
    assert np.isfinite(vector).all()


def test_feature_vector_layout(vectors):
    row = features.feature_vector(vectors, 4).where("window_id = 3").first()
    assert len(row["features"]) == 2 * 5 * 10
    own = {r["ch"]: np.array(r["x"])[None, :] for r in vectors.where("window_id = 3").collect()}
    want = np.concatenate(
        [bandstats.band_stats(b)[0] for c in (0, 1) for b in wavelet.decompose(own[c], 4)]
    )
    want = np.nan_to_num(want, nan=0.0, posinf=5.0, neginf=0.0)
    np.testing.assert_allclose(row["features"], want, rtol=1e-5)


def test_windows_of_unequal_length(spark):
    rows = [(i, np.arange(n, dtype=float).tolist()) for i, n in enumerate((8, 12, 8))]
    df = spark.createDataFrame(rows, "window_id bigint, x array<double>")
    got = {r["window_id"]: r["max"] for r in features.band_stats(df).collect()}
    assert got == {0: 7.0, 1: 11.0, 2: 7.0}


def test_welch_spectrum(vectors):
    x = stacked(vectors)[0]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    want = np.zeros(33)
    for start in (0, 32, 64):
        part = (x[start : start + 64] - x[start : start + 64].mean()) * taper
        want += np.abs(np.fft.rfft(part)) ** 2 / 3
    want /= 256 * (taper**2).sum()
    want[1:-1] *= 2
    got = features.power_spectrum(vectors, nperseg=64).where("window_id = 0 and ch = 0").orderBy("bin")
    rows = got.collect()
    np.testing.assert_allclose([r["power"] for r in rows], want, rtol=1e-10)
    assert rows[1]["freq"] == 4.0


def test_band_power_is_the_mean_area(vectors):
    spectra = features.power_spectrum(vectors, nperseg=128)
    got = {
        (r["ch"], r["y"], r["band"]): r["power"]
        for r in features.band_power(features.class_spectrum(spectra)).collect()
    }
    areas = {}
    per_window = {}
    for r in spectra.orderBy("bin").collect():
        if 8 <= r["freq"] < 13:
            per_window.setdefault((r["window_id"], r["ch"], r["y"]), []).append((r["freq"], r["power"]))
    for (_, ch, y), points in per_window.items():
        f, p = np.array(points).T
        areas.setdefault((ch, y), []).append(np.trapezoid(p, f))
    for (ch, y), values in areas.items():
        assert got[(ch, y, "alpha")] == pytest.approx(np.mean(values))


def test_channel_correlation(vectors):
    x = stacked(vectors).reshape(20, 2, 128)
    y = np.array([int(i % 4 == 0) for i in range(20)])
    r = np.array([np.corrcoef(w)[0, 1] for w in x])
    row = audit.channel_correlation(vectors).first()
    assert row["preictal"] == pytest.approx(r[y == 1].mean())
    assert row["delta"] == pytest.approx(r[y == 1].mean() - r[y == 0].mean())


def test_augmentations_are_repeatable_and_bounded(vectors):
    original = {(r["window_id"], r["ch"]): np.array(r["x"]) for r in vectors.collect()}

    def run(step):
        return {(r["window_id"], r["ch"]): np.array(r["x"]) for r in step(vectors).collect()}

    for step in (augment.time_shift, augment.amplitude_scale, augment.gaussian_noise):
        first, second = run(step), run(step)
        changed = 0
        for key, x in first.items():
            np.testing.assert_array_equal(x, second[key])
            changed += not np.array_equal(x, original[key])
        assert 0 < changed < len(original)
    for key, x in run(augment.time_shift).items():
        np.testing.assert_allclose(np.sort(x), np.sort(original[key]))
    for key, x in run(augment.amplitude_scale).items():
        assert 0.8 <= (x / original[key]).mean() <= 1.2
    for key, x in run(augment.gaussian_noise).items():
        assert np.abs(x - original[key]).max() < 0.1
    dropped = run(lambda df: augment.channel_dropout(df, 2, p=1.0))
    for window in range(20):
        assert sum(not dropped[(window, c)].any() for c in (0, 1)) == 1


def test_noise_differs_between_windows(vectors):
    noisy = augment.gaussian_noise(vectors, p=1.0).where("ch = 0")
    back = noisy.join(vectors.where("ch = 0").select("window_id", F.col("x").alias("o")), "window_id")
    first = [r["x"][0] - r["o"][0] for r in back.collect()]
    assert len(set(np.round(first, 12))) == len(first)
