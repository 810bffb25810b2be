import numpy as np
import pytest
from pyspark.sql import functions as F

from paroxys.operators import recursive, windows
from paroxys.operators.ordered import dense_index, ordered_bucket, running, with_halo


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(3)
    rows = [(u, i, float(v)) for u, n in ((1, 1024), (2, 256), (3, 100)) for i, v in enumerate(rng.normal(size=n))]
    return spark.createDataFrame(rows, "user_id bigint, i bigint, value double")


def arrays(df, value="value"):
    out = {}
    for r in df.orderBy("user_id", "i").collect():
        out.setdefault(r["user_id"], []).append(r[value])
    return {u: np.array(v) for u, v in out.items()}


@pytest.mark.parametrize("make", [windows.sliding_windows, windows.sliding_windows_by_copy])
def test_window_counts(signal, make):
    got = dict(make(signal, 256, 128).groupBy("user_id").count().collect())
    assert got == {1: 7, 2: 1}


@pytest.mark.parametrize("window,stride,size", [(64, 16, 48), (64, 64, 64), (32, 50, 100), (48, 20, 7)])
def test_windows_hold_the_right_samples(signal, window, stride, size):
    data = arrays(signal)
    got = windows.sliding_windows(signal, window, stride, size=size).collect()
    want = {
        (u, k): x[k * stride : k * stride + window].tolist()
        for u, x in data.items()
        for k in range(max((len(x) - window) // stride + 1, 0))
    }
    assert {(r["user_id"], r["k"]): r["x"] for r in got} == want
    copied = windows.sliding_windows_by_copy(signal, window, stride).collect()
    assert {(r["user_id"], r["k"]): r["x"] for r in copied} == want


@pytest.mark.parametrize("size", [100, 1 << 14])
def test_cutting_chosen_windows(signal, size):
    df = signal.withColumn("channel", F.lit("T7"))
    lengths = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_samples"))
    spots = windows.window_positions(lengths, 64, 16)
    every = windows.cut_chosen(df, spots.drop("n_samples"), 64, 16, ["user_id"], size=size)
    whole = windows.sliding_windows(signal, 64, 16)
    key = lambda rows: {(r["user_id"], r["k"]): r["x"] for r in rows}
    assert key(every.collect()) == key(whole.collect())
    some = spots.where("k % 3 = 1").select("user_id", "k", F.lit(7).alias("y"))
    cut = windows.cut_chosen(df, some, 64, 16, ["user_id"], size=size).collect()
    assert {r["k"] % 3 for r in cut} == {1} and {r["y"] for r in cut} == {7}


def test_window_arguments(signal):
    with pytest.raises(ValueError):
        windows.sliding_windows(signal, 0, 1)


def test_start_seconds(signal):
    cut = windows.start_seconds(windows.sliding_windows(signal, 256, 128), 128, 256.0)
    assert {r["start_sec"] for r in cut.where("user_id = 1").collect()} == {k / 2 for k in range(7)}


@pytest.mark.parametrize("size", [50, 1 << 16])
def test_zscore_and_minmax(signal, size):
    data = arrays(signal)
    z = arrays(windows.zscore(signal, ["user_id"], size=size))
    m = arrays(windows.minmax(signal, ["user_id"], size=size))
    for u, x in data.items():
        np.testing.assert_allclose(z[u], (x - x.mean()) / (x.std() + 1e-6), atol=1e-9)
        np.testing.assert_allclose(m[u], (x - x.min()) / (np.ptp(x) + 1e-8), atol=1e-9)


@pytest.mark.parametrize("mode", ["zscore", "minmax"])
def test_constant_signal_stays_finite(spark, mode):
    flat = spark.createDataFrame([(1, i, 1.0) for i in range(9)], "user_id bigint, i bigint, value double")
    assert np.isfinite(arrays(windows.normalise(flat, mode, group=["user_id"]))[1]).all()


def test_other_mode_is_identity(signal):
    assert windows.normalise(signal, "none") is signal


def test_zscore_window(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0])], "window_id int, x array<double>")
    x = np.array([1.0, 2.0, 4.0])
    got = windows.zscore_window(df).first()["x"]
    np.testing.assert_allclose(got, (x - x.mean()) / (x.std() + 1e-6))


def test_downsample(signal):
    data, got = arrays(signal), arrays(windows.downsample(signal, 512, 256))
    np.testing.assert_allclose(got[1], data[1].reshape(-1, 2).mean(axis=1))
    with pytest.raises(ValueError):
        windows.downsample(signal, 128, 256)


@pytest.mark.parametrize("size", [40, 1 << 16])
def test_trend(signal, size):
    data, got = arrays(signal), arrays(windows.trend_seasonal(signal, size=size), "trend")
    for u, x in data.items():
        want = [x[max(i - 12, 0) : i + 13].mean() for i in range(len(x))]
        np.testing.assert_allclose(got[u], want, atol=1e-12)


def naive_both_ways(b, a, x, pad):
    def once(v):
        y = np.zeros(len(v))
        gain = sum(b) / sum(a)
        for t in range(len(v)):
            past_x = [v[t - j] if t >= j else v[0] for j in range(len(b))]
            past_y = [y[t - j] if t >= j else gain * v[0] for j in range(1, len(a))]
            y[t] = np.dot(b, past_x) - np.dot(a[1:], past_y)
        return y

    head = [2 * x[0] - x[j] for j in range(pad, 0, -1)]
    tail = [2 * x[-1] - x[-1 - j] for j in range(1, pad + 1)]
    ext = np.array([*head, *x, *tail])
    return once(once(ext)[::-1])[::-1][pad : pad + len(x)]


@pytest.mark.parametrize("size", [1, 1 << 16])
def test_recursive_filter(signal, size):
    b, a = (0.2, 0.3, 0.1), (1.0, -0.5, 0.25)
    data, got = arrays(signal), arrays(recursive.iir_filter(signal, b, a, size=size))
    for u, x in data.items():
        np.testing.assert_allclose(got[u], naive_both_ways(b, a, x, 9), atol=1e-10)


@pytest.mark.parametrize(
    ("b", "a"),
    [
        ((1e-8,), np.poly([0.99] * 4)),  # a pole of multiplicity four
        ((0.5, -0.5), (1.0, -0.98)),  # no gain at rest
        (np.poly([-1.0] * 4) * 1e-3, np.poly([0.9 + 0.3j, 0.9 - 0.3j, 0.8, 0.7, -0.5])),
        ((1.0, 2.0, 3.0), (2.0,)),  # no recursion
    ],
    ids=["fourfold", "cancelling", "mixed", "moving sum"],
)
def test_filters_do_not_depend_on_the_chunks(spark, b, a):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=40_000)) * 0.1 + 50
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "user_id int, i bigint, value double")
    found = []
    for size in (1, 10_000, 1 << 17):
        rows = recursive.iir_filter(df, b, a, size=size).orderBy("i").collect()
        found.append(np.array([r["value"] for r in rows]))
    scale = np.abs(found[-1]).max()
    for other in found[:-1]:
        assert np.abs(other - found[-1]).max() <= 1e-12 * scale


def test_unstable_filter_is_refused(signal):
    with pytest.raises(ValueError):
        recursive.iir_filter(signal, (1.0,), (1.0, -1.1))


def test_running_crosses_chunks(spark):
    rows = [(g, i, i % 5) for g in (1, 2) for i in range(23)]
    df = spark.createDataFrame(rows, "g int, i int, v int").withColumn("c", F.floor(F.col("i") / 4))
    got = running(df, ["g"], "c", ["i"], sums={"s": F.col("v")}, maxes={"m": F.when(F.col("v") == 4, F.col("i"))})
    values = [r[2] for r in rows[:23]]
    for r in got.collect():
        i = r["i"]
        assert r["s"] == sum(values[: i + 1])
        assert r["m"] == max((j for j in range(i + 1) if values[j] == 4), default=None)


def test_dense_index_and_buckets(spark):
    keys = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)], "key string")
    ranged = ordered_bucket(keys.distinct(), "key", buckets=16)
    assert ranged.select("chunk").distinct().count() > 8
    rows = dense_index(ranged, [], "chunk", ["key"]).orderBy("i").collect()
    assert [r["key"] for r in rows] == [f"k{i:04d}" for i in range(500)]


def test_halo_must_fit(signal):
    with pytest.raises(ValueError):
        with_halo(signal, "i", 10, 0, 5)


@pytest.mark.parametrize("cut", [windows.sliding_windows, windows.sliding_windows_by_copy])
@pytest.mark.parametrize("spoil", ["gap", "double", "both"])
def test_missing_or_doubled_samples_fail(spark, cut, spoil):
    places = {"gap": [0, 1, 2, 4, 5, 6, 7], "double": [0, 1, 2, 2, 3, 4, 5], "both": [0, 1, 1, 3, 4, 5, 6]}[spoil]
    rows = spark.createDataFrame([(1, i, float(i)) for i in places], "user_id bigint, i bigint, value double")
    with pytest.raises(Exception, match="missing or given twice"):
        cut(rows, 4, 4).collect()
