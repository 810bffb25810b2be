"""Plain SQL for the catalogue, written against the driver tables and run by DuckDB.

The SQL restates each definition directly (self-joins, correlated maxima, recursion over
lists); it shares no code or plan with the Spark side.
"""

from __future__ import annotations

T0 = "timestamp '2024-01-01 00:00:00'"
SEC = f"(epoch_us(ts) - epoch_us({T0})) / 1e6"

RAW = """case event_type when 'view' then 'EEG T3' when 'click' then 'eeg F7'
  when 'error' then 'T8 ' when 'signup' then 'F8' else 'EKG P7' end"""
NAME = """case event_type when 'view' then 'T7' when 'click' then 'F7'
  when 'error' then 'T8' when 'signup' then 'F8' else 'P7' end"""

SAMPLES = f"""samples as (
  select user_id, event_id, event_type, {NAME} as channel, value, {SEC} as t_sec,
    row_number() over (partition by user_id order by ts, event_id) - 1 as i
  from events)"""
SCORED = f"""{SAMPLES},
scored as (
  select user_id, i as k, cast(event_type in ('error', 'purchase') as int) as y,
    value / (value + 50) as prob, cast(value / (value + 50) >= 0.5 as int) as pred,
    user_id % 10 as fold
  from samples)"""
FLAT = """flat as (
  select user_id, cast(user_id % 10 as int) as fold,
    cast(event_type in ('error', 'purchase') as int) as y,
    value / (value + 50) as prob, cast(value / (value + 50) >= 0.5 as int) as pred,
    (value - 50) / 50 as l1, -(value - 50) / 50 as l0
  from events)"""
VECTORS = """vectors as (
  select vec_id as window_id, cast(vec_id % 10 as int) as subject,
    cast(label = 0 as int) as y, cast(embedding as double[]) as x
  from embeddings)"""
CHANNELS = f"""{VECTORS},
chans as (
  select window_id, subject, y, cast(c as int) as ch, x[c * 16 + 1 : c * 16 + 16] as x
  from vectors, range(4) as r(c))"""
SEIZURES = f"""wins as (select user_id, event_id as window_id, {SEC} as s, {SEC} + 4 as e from events),
seizures as (
  select user_id, {SEC} as onset, {SEC} + 60 * value as stop
  from events where event_type = 'purchase' and value > 150)"""


def _prediction(sop: float) -> str:
    return f"""max(case when z.onset is not null and w.s >= z.onset - 18000 - {sop}
        and w.e <= z.onset - 18000 then 1 else 0 end)"""


LABELS = f"""{SEIZURES},
zoned as (
  select w.user_id, w.window_id,
    max(case when w.s < z.stop and w.e > z.onset then 1
      when w.s < z.onset and w.e > z.onset - 18000 then 1
      when w.s < z.stop + 54000 and w.e > z.stop then 1 else 0 end) as excluded,
    {_prediction(54000)} as p15, {_prediction(36000)} as p10, {_prediction(18000)} as p5
  from wins w left join seizures z on w.user_id = z.user_id
  group by all),
labelled as (
  select user_id, window_id, p15 as y_sop15, p10 as y_sop10, p5 as y_sop5
  from zoned where excluded = 0)"""

DIGEST = """len({x}) as n, round(list_sum({x}), 6) as total,
  round(list_sum([{x}[j] * j for j in range(1, len({x}) + 1)]), 6) as weighted"""


def digest(x: str) -> str:
    return DIGEST.replace("{x}", x)


def div(top: str, bottom: str) -> str:
    return f"coalesce(cast({top} as double) / nullif({bottom}, 0), 0.0)"


def rates(tp="tp", tn="tn", fp="fp", fn="fn", wrap="round({}, 6)") -> str:
    forms = {
        "accuracy": div(f"{tp} + {tn}", f"({tp} + {tn} + {fp} + {fn})"),
        "recall": div(tp, f"({tp} + {fn})"),
        "precision": div(tp, f"({tp} + {fp})"),
        "specificity": div(tn, f"({tn} + {fp})"),
        "f1": div(f"2 * {tp}", f"(2 * {tp} + {fp} + {fn})"),
        "fpr": div(fp, f"({fp} + {tn})"),
    }
    return ", ".join(f"{wrap.format(form)} as {name}" for name, form in forms.items())


COUNTS = """count(*) filter (where y = 1 and pred = 1) as tp,
  count(*) filter (where y <> 1 and pred <> 1) as tn,
  count(*) filter (where y <> 1 and pred = 1) as fp,
  count(*) filter (where y = 1 and pred <> 1) as fn"""

METRICS = ("accuracy", "recall", "precision", "specificity", "f1", "fpr")


def means(names) -> str:
    return ", ".join(
        f"round(avg({m}), 6) as mean_{m}, round(stddev_pop({m}), 6) as std_{m}" for m in names
    )


def thresholds(n: int) -> str:
    return f"""thr as (select case when i = {n - 1} then 1.0::double
    else i * (1.0::double / {n - 1}) end as threshold from range({n}) as r(i))"""


def auc(table: str, by: str) -> str:
    """Rank-sum form: mean rank of the positives among all scores."""
    part = f"partition by {by}" if by else ""
    select = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""(select {select}count(*) filter (where y = 1) as n_pos,
      count(*) filter (where y <> 1) as n_neg,
      coalesce((sum(mid) filter (where y = 1)
        - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0)
        / nullif(cast(count(*) filter (where y = 1) as double) * count(*) filter (where y <> 1), 0), 0.0)
        as auc_roc
    from (select *, rank() over ({part} order by prob)
        + (count(*) over ({part + ',' if part else 'partition by'} prob) - 1) / 2.0 as mid
      from {table}) {group})"""


def runs(table: str, value: str, name: str, keys: str = "user_id") -> str:
    return f"""{name} as (
  select {keys}, min(k) as start_k, max(k) as end_k
  from (select *, k - row_number() over (partition by {keys} order by k) as island
    from {table} where {value} = 1)
  group by {keys}, island)"""


def event_metrics(by: str, table: str, seconds: float, credit: str, source: str = SCORED) -> str:
    """Run-to-run overlap joins; ``by`` is '', 'user_id' or 'fold'."""
    agg = "min" if credit == "first" else None
    met = (
        """select p.user_id, p.start_k as p_start, min(t.start_k) as t_start
      from preds p left join trues t on p.user_id = t.user_id
        and p.start_k <= t.end_k and p.end_k >= t.start_k
      group by all"""
        if agg
        else """select p.user_id, p.start_k as p_start, t.start_k as t_start
      from preds p left join trues t on p.user_id = t.user_id
        and p.start_k <= t.end_k and p.end_k >= t.start_k"""
    )
    key = {"": "0", "user_id": "user_id", "fold": "user_id % 10"}[by]
    select = {"": "", "user_id": "base.g as user_id,", "fold": "base.g as fold,"}[by]
    return f"""with {source},
{runs(table, 'y', 'trues')},
{runs(table, 'pred', 'preds')},
met as ({met}),
base as (select {key} as g, count(*) as n_windows from {table} group by 1),
t as (select {key} as g, count(*) as n from trues group by 1),
d as (select g, count(*) as n from (select distinct {key} as g, user_id, t_start from met
  where t_start is not null) group by 1),
f as (select {key} as g, count(*) as n from met where t_start is null group by 1)
select {select} coalesce(d.n, 0) as n_detected, coalesce(t.n, 0) as n_seizures,
  coalesce(f.n, 0) as n_false_alarms, base.n_windows,
  round(base.n_windows * {seconds} / 3600.0, 6) as hours,
  round(coalesce(d.n, 0) / cast(greatest(coalesce(t.n, 0), 1) as double), 6) as detection_rate,
  round(coalesce(f.n, 0) / greatest(base.n_windows * cast({seconds} as double) / 3600.0, 1e-12), 6) as fp_per_hour
from base left join t using (g) left join d using (g) left join f using (g)"""


def vote(source: str, n: int, k: int, out: str) -> str:
    half = n // 2
    return f"""{out} as (
  select user_id, k, y, prob, fold, cast(case
      when count(*) over (partition by user_id) < {n} then pred
      when sum(pred) over (partition by user_id order by k
        rows between {half} preceding and {half} following) >= {k} then 1 else 0 end as int) as pred
  from {source})"""


def bridge(source: str, collar: int, out: str) -> str:
    return f"""{out}_near as (
  select *, max(case when pred = 1 then k end) over (partition by user_id order by k
      rows between unbounded preceding and 1 preceding) as before_k,
    min(case when pred = 1 then k end) over (partition by user_id order by k
      rows between 1 following and unbounded following) as after_k
  from {source}),
{out} as (
  select user_id, k, y, prob, fold,
    cast(case when pred = 1 or after_k - before_k - 1 <= {collar} then 1 else 0 end as int) as pred
  from {out}_near)"""


# Daubechies-4 analysis low-pass filter.
LOW = (
    -0.010597401784997278,
    0.032883011666982945,
    0.030841381835986965,
    -0.18703481171888114,
    -0.02798376941698385,
    0.6308807679295904,
    0.7148465705525415,
    0.23037781330885523,
)
HIGH = tuple((-1) ** (j + 1) * LOW[7 - j] for j in range(8))


def analyse(x: str, taps) -> str:
    terms = []
    for j, tap in enumerate(taps):
        at = f"((2 * k + 1 - {j} + 2 * len({x})) % (2 * len({x})))"
        terms.append(
            f"cast({tap} as double) * {x}[1 + case when {at} < len({x}) then {at} else 2 * len({x}) - 1 - {at} end]"
        )
    return f"[{' + '.join(terms)} for k in range(cast((len({x}) + 7) // 2 as bigint))]"


def levels(source: str, depth: int, keys: str = "window_id") -> str:
    parts, previous, column = [], source, "x"
    for level in range(1, depth + 1):
        parts.append(
            f"lev{level} as (select {keys}, {analyse(column, LOW)} as a{level},"
            f" {analyse(column, HIGH)} as d{level} from {previous})"
        )
        previous, column = f"lev{level}", f"a{level}"
    return ",\n".join(parts)


def key(col: str, seed: int) -> str:
    return f"cast('0x' || substr(md5('{seed}:' || cast({col} as varchar)), 1, 13) as bigint)"


def uniform(col: str, seed: int) -> str:
    return f"({key(col, seed)} / 4503599627370496.0::double)"


PLACED = f"""placed as (
  select *, row_number() over (partition by y order by {key('window_id', 42)}, window_id) - 1 as pos,
    count(*) over (partition by y) as n
  from vectors)"""

STATS = """stats as (
  select {keys}, list_min(x) as mn, list_max(x) as mx, list_avg(x) as mu, len(x) as n, x,
    list_sum([(v - list_avg(x)) ** 2 for v in x]) / len(x) as m2,
    list_sum([(v - list_avg(x)) ** 3 for v in x]) / len(x) as m3,
    list_sum([(v - list_avg(x)) ** 4 for v in x]) / len(x) as m4
  from {source})"""


def stats(source: str, keys: str = "window_id") -> str:
    return STATS.replace("{keys}", keys).replace("{source}", source)


def entropies(source: str, keys: str = "window_id", limit: int = 64) -> str:
    """Sample, permutation and Shannon entropy of rows ``({keys}, x)``, from points."""
    on = " and ".join(f"a.{c} = b.{c}" for c in keys.replace(" ", "").split(","))
    return f"""points as (
  select {keys}, p as i, x[p + 1] as v, len(x) as n
  from {source}, range(0, len(x)) as r(p)),
firsts as (
  select *, least(n, {limit}) as m from points where i < {limit}),
radii as (select {keys}, 0.2 * stddev_samp(v) as r from firsts group by all),
leads as (
  select f.*, r.r, lead(v, 1) over w as v1, lead(v, 2) over w as v2
  from firsts f join radii r using ({keys}) window w as (partition by {keys} order by i)),
pairs as (
  select {', '.join('a.' + c for c in keys.replace(' ', '').split(','))},
    count(*) filter (where b.i < a.m - 2 and greatest(abs(a.v - b.v), abs(a.v1 - b.v1)) <= a.r) as b_n,
    count(*) filter (where b.i < a.m - 3
      and greatest(abs(a.v - b.v), abs(a.v1 - b.v1), abs(a.v2 - b.v2)) <= a.r) as a_n
  from leads a join leads b on {on} and a.i < b.i group by all),
sampen as (
  select {keys}, case when r.r = 0 or coalesce(b_n, 0) = 0 then 0.0
    when a_n = 0 then 5.0 else -ln(a_n / b_n::double) end as entropy
  from radii r left join pairs using ({keys})),
shapes as (
  select {keys}, n, (v <= v1)::int * 4 + (v <= v2)::int * 2 + (v1 <= v2)::int as shape
  from (select *, lead(v, 1) over w as v1, lead(v, 2) over w as v2 from points
    window w as (partition by {keys} order by i)) where v2 is not null),
shares as (
  select {keys}, shape, count(*) / any_value(n - 2)::double as p from shapes group by all),
perment as (
  select {keys}, -sum(p * log2(p + 1e-12)) as entropy from shares group by all),
bins as (
  select {keys}, v, n, min(v) over (partition by {keys}) as lo, max(v) over (partition by {keys}) as hi
  from points),
cells as (
  select {keys}, least(floor((v - lo) / (hi - lo) * 32), 31) as cell, count(*) / any_value(n)::double as p
  from bins where hi > lo group by all),
shannon as (select {keys}, -sum(p * log2(p)) as entropy from cells group by all)"""


LINES_SIENA = """lines as (
  select 'user' || user_id as subject, event_id,
    20 * 3600 as begin_s, hour(ts) * 3600 + minute(ts) * 60 + second(ts) as on_s,
    ts + to_seconds(cast(floor(value) as bigint)) as stop, value
  from events where event_type = 'purchase' and value > 150)"""


def _summary() -> str:
    return f"""with {LABELS}, summary as (
  select count(*) as samples, sum(y_sop15) as positive, count(*) - sum(y_sop15) as negative,
    avg(y_sop15) as class_ratio, count(distinct user_id % 10) as num_subjects,
    count(distinct user_id) as record_count from labelled)"""


CHECKS = """checks as (
  select 'has_windows' as "check", case when samples > 0 then 'PASS' else 'FAIL' end as status,
    samples::double as value from summary
  union all select 'has_positives', case when positive > 0 then 'PASS' else 'FAIL' end, positive from summary
  union all select 'counts_add_up', case when positive + negative = samples then 'PASS' else 'FAIL' end,
    positive + negative from summary
  union all select 'several_subjects', case when num_subjects >= 2 then 'PASS' else 'FAIL' end, num_subjects from summary
  union all select 'positive_share', case when class_ratio between 0.005 and 0.2 then 'PASS' else 'WARN' end,
    class_ratio from summary)"""

VOTED_SWEEP = f"""with {SCORED}, {thresholds(21)},
cut as (
  select user_id, threshold, k, y, cast(prob >= threshold as int) as pred
  from scored, thr),
voted as (
  select user_id, threshold, k, y,
    case when count(*) over (partition by user_id, threshold) < 3 then pred
      when sum(pred) over (partition by user_id, threshold order by k
        rows between 1 preceding and 1 following) >= 2 then 1 else 0 end as pred
  from cut),
near as (
  select *, max(case when pred = 1 then k end) over (partition by user_id, threshold order by k
      rows between unbounded preceding and 1 preceding) as before_k,
    min(case when pred = 1 then k end) over (partition by user_id, threshold order by k
      rows between 1 following and unbounded following) as after_k
  from voted),
merged as (
  select threshold, y, case when pred = 1 or after_k - before_k - 1 <= 3 then 1 else 0 end as pred
  from near),
c as (select threshold, {COUNTS} from merged group by 1)
select round(threshold, 6) as threshold, tp, tn, fp, fn, {rates()} from c"""

SWEEP = f"""{FLAT}, {thresholds(51)},
c as (
  select threshold, count(*) filter (where y = 1 and prob >= threshold) as tp,
    count(*) filter (where y <> 1 and not prob >= threshold) as tn,
    count(*) filter (where y <> 1 and prob >= threshold) as fp,
    count(*) filter (where y = 1 and not prob >= threshold) as fn
  from flat, thr group by 1)"""

LOSSES = f"""with {FLAT},
n as (select fold, count(*) as n, count(*) filter (where y = 1) as n1 from flat group by 1),
r as (
  select f.*, greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) as lse,
    1 / (1 + exp(l0 - l1)) as p1,
    case when y = 1 then n.n / (2.0::double * n1) else n.n / (2.0::double * (n.n - n1)) end as w
  from flat f join n using (fold)),
q as (
  select *, case when y = 1 then lse - l1 else lse - l0 end as ce,
    case when y = 1 then p1 else 1 / (1 + exp(l1 - l0)) end as pt from r),
s as (
  select fold, avg(w * ce) as wce, avg(w * (1 - pt) ** 2 * -ln(pt + 1e-8)) as focal,
    avg(w * (0.05 * (lse - l0) + 0.05 * (lse - l1) + 0.9 * ce)) as smooth,
    sum(p1 * y) as tp, sum(p1 * (1 - y)) as fp, sum((1 - p1) * (1 - y)) as tn, sum((1 - p1) * y) as fn
  from q group by 1)
select fold, round(wce, 6) as weighted_ce, round(focal, 6) as focal,
  round(wce + 0.5 * (1 - tn / (tn + fp + 1e-8)) + 0.5 * (1 - tp / (tp + fn + 1e-8)), 6) as sswce,
  round(smooth, 6) as label_smoothing from s"""

def cut_windows(win: int, stride: int, seconds: bool) -> str:
    extra = f"round(k * {stride} / 256.0::double, 6) as start_sec," if seconds else ""
    return f"""with {SAMPLES},
n as (select user_id, count(*) as t from samples group by 1),
w as (select user_id, unnest(generate_series(0, (t - {win}) // {stride})) as k from n where t >= {win}),
m as (
  select w.user_id, w.k, list(s.value order by s.i) as x
  from w join samples s on s.user_id = w.user_id
    and s.i >= w.k * {stride} and s.i < w.k * {stride} + {win}
  group by all)
select user_id, k, k * {stride} as start, {extra} {digest('x')} from m"""


def psd() -> str:
    n = 64
    return f"""{VECTORS},
pts as (
  select window_id, y, p, (x[p + 1] - list_avg(x)) * (0.5 - 0.5 * cos(2 * pi() * p / {n})) as v
  from vectors, range({n}) as r(p)),
pw as (
  select window_id, y, b as bin,
    (sum(v * cos(2 * pi() * b * p / {n})) ** 2 + sum(v * sin(2 * pi() * b * p / {n})) ** 2)
    / (256.0 * {n} * 0.375) * max(case when b in (0, {n // 2}) then 1 else 2 end) as power
  from pts, range({n // 2 + 1}) as r(b) group by all),
spectrum as (
  select 0 as ch, y, bin, bin * 256.0::double / {n} as freq, avg(power) as mean_power,
    stddev_pop(power) as std_power from pw group by all)"""


LONG = """chans as (
  select vec_id // 64 as window_id, cast(vec_id // 64 % 10 as int) as subject, cast(vec_id // 64 % 3 = 0 as int) as y,
    cast(vec_id % 64 // 16 as int) as ch, flatten(list(cast(embedding as double[]) order by vec_id)) as x
  from embeddings group by all having count(*) = 16)"""


def feature_vector(source: str, depth: int, limit: int = 64) -> str:
    """Ten statistics per band and channel, concatenated in order, approximation first."""
    bands = [f"select window_id, ch, 0 as band, a{depth} as x from lev{depth}"]
    bands += [f"select window_id, ch, {depth - d + 1}, d{d} from lev{d}" for d in range(depth, 0, -1)]
    return f"""with {source}, {levels('chans', depth, 'window_id, ch')},
bands as ({' union all '.join(bands)}),
{stats('bands', 'window_id, ch, band')},
{entropies('bands', 'window_id, ch, band', limit)},
f as (
  select window_id, ch, band, cast([mn, mx, mu, m2, sqrt(m2), m3 / m2 ** 1.5, m4 / m2 ** 2 - 3,
    e.entropy, p.entropy, h.entropy] as float[]) as f
  from stats join sampen e using (window_id, ch, band) join perment p using (window_id, ch, band)
    join shannon h using (window_id, ch, band)),
v as (select window_id, cast(flatten(list(f order by ch, band)) as double[]) as x from f group by 1),
ids as (select distinct window_id, subject, y from chans)
select window_id, subject, y, {digest('v.x')} from v join ids using (window_id)"""


def synthesise(low: str, high: str) -> str:
    """Upsample both bands, filter with the reversed taps and add."""
    terms = []
    for band, taps in ((low, LOW), (high, HIGH)):
        values = "[" + ", ".join(f"cast({t} as double)" for t in reversed(taps)) + "]"
        for q in range(4):
            j = f"(t % 2 + {2 * q})"
            terms.append(f"{values}[{j} + 1] * {band}[(t + 6 - {j}) // 2 + 1]")
    return f"[{' + '.join(terms)} for t in range(2 * len({high}) - 6)]"


def rebuilt(depth: int, kept: set[int], key: str, prefix: str = "up", keep_approx: bool = True) -> str:
    """CTEs ``{prefix}{depth}`` to ``{prefix}1`` that go up again with some details; ``r1`` is the signal."""
    up, approx = [], f"a{depth}" if keep_approx else f"[0.0::double for v in a{depth}]"
    for level in range(depth, 0, -1):
        detail = f"d{level}" if level in kept else f"[0.0::double for v in d{level}]"
        source = f"lev{level}" if level == depth else f"{prefix}{level + 1} join lev{level} using ({key})"
        up.append(
            f"{prefix}{level} as (select l.{key}, {synthesise('low', 'high')} as r{level} from ("
            f"select {key}, ({approx})[1 : len(d{level})] as low, {detail} as high from {source}) l)"
        )
        approx = f"r{level}"
    return ", ".join(up)


def subbands(depth: int) -> str:
    """Each band alone, rebuilt to the length of its window."""
    parts, found = [], []
    for band in range(depth + 1):
        kept = {depth + 1 - band} if band else set()
        parts.append(rebuilt(depth, kept, "window_id", f"b{band}_", band == 0))
        found.append(f"select window_id, {band} as band, {digest('x')} from (select window_id, r1[1:64] as x from b{band}_1)")
    return f"""with {VECTORS}, {levels('vectors', depth)}, {', '.join(parts)}
{' union all '.join(found)}"""


def dwt_filter() -> str:
    """Five levels down, the two finest details dropped, and up again."""
    return f"""with {SAMPLES},
recs as (select user_id, list(value order by i) as x from samples group by 1),
{levels('recs', 5, 'user_id')},
{rebuilt(5, {3, 4, 5}, 'user_id')}
select user_id, i, round(r1[i + 1], 6) as value from samples join up1 using (user_id)"""


def both_ways(source: str) -> str:
    """CTEs of the recursion step by step over reflected recordings ``(user_id, x)``, forward
    then backward; ``done`` has the padded result ``x``."""
    b0, b1, a2 = "0.2928932188134524::double", "0.5857864376269049::double", "0.1715728752538099::double"

    def step(name: str, source: str) -> str:
        return f"""{name} as (
  select user_id, 1 as t, ({b0} + {b1} + {b0}) * e[1] - {a2} * e[1] as y, e[1] as y1, e, pad from {source}
  union all
  select user_id, t + 1, {b0} * e[t + 1] + {b1} * e[t] + {b0} * e[greatest(t - 1, 1)] - {a2} * y1, y, e, pad
  from {name} where t < len(e))"""

    return f"""ext as (
  select user_id, least(9, len(x) - 1) as pad,
    [2 * x[1] - x[least(9, len(x) - 1) + 1 - j] for j in range(least(9, len(x) - 1))] || x
    || [2 * x[len(x)] - x[len(x) - 1 - j] for j in range(least(9, len(x) - 1))] as e from {source}),
{step('fwd', 'ext')},
turned as (select user_id, pad, list(y order by t desc) as e from fwd group by 1, 2),
{step('bwd', 'turned')},
done as (select user_id, pad, list(y order by t desc) as x from bwd group by 1, 2)"""


def iir_filter() -> str:
    return f"""with recursive {SAMPLES},
recs as (select user_id, list(value order by i) as x from samples group by 1),
{both_ways('recs')}
select user_id, i, round(x[i + pad + 1], 6) as value from samples join done using (user_id)"""


def prepared() -> str:
    """CTEs up to ``m``: two samples averaged to one, filtered, rebuilt from the kept bands, scaled, cut and labelled."""
    return f"""with recursive {SAMPLES},
halved as (select user_id, i // 2 as i, avg(value) as value from samples group by all),
recs as (select user_id, list(value order by i) as x from halved group by 1),
{both_ways('recs')},
smooth as (select d.user_id, d.x[pad + 1 : pad + len(r.x)] as x from done d join recs r using (user_id)),
{levels('smooth', 5, 'user_id')},
{rebuilt(5, {3, 4, 5}, 'user_id')},
clean as (select user_id, i, r1[i + 1] as value from halved join up1 using (user_id)),
z as (select user_id, i, (value - avg(value) over w) / (stddev_pop(value) over w + 1e-6) as v
  from clean window w as (partition by user_id)),
n as (select user_id, count(*) as t from halved group by 1),
k as (select user_id, unnest(generate_series(0, (t - 8) // 4)) as k from n where t >= 8),
q as (select user_id, i / 2.0::double as a, i / 2.0::double + 2 as b from samples
  where event_type = 'purchase' and value > 150),
l as (select k.user_id, k.k,
    max(case when 4 * k < b and 4 * k + 8 > a then 1 when 4 * k < a and 4 * k + 8 > a - 4 then 1
      when 4 * k < b + 8 and 4 * k + 8 > b then 1 else 0 end) as bad,
    max(case when 4 * k >= a - 12 and 4 * k + 8 <= a - 4 then 1 else 0 end) as y_near,
    max(case when 4 * k >= a - 20 and 4 * k + 8 <= a - 4 then 1 else 0 end) as y_far
  from k left join q on q.user_id = k.user_id group by all),
m as (select l.user_id, l.k, y_near, y_far, list(v order by i) as x
  from l join z on z.user_id = l.user_id and i >= 4 * l.k and i < 4 * l.k + 8 where bad = 0 group by all)"""


def prepare_dataset() -> str:
    return f"""{prepared()}
select cast(user_id as varchar) as recording, 'T7' as channel, k, k * 4.0::double as start_sec,
  y_near, y_far, {digest('x')} from m"""


def conformance() -> str:
    """Twenty-seven checks of the prepared windows."""

    def check(name: str, ok: str, value: str, good: str = "PASS") -> str:
        return f"""select '{name}' as "check", case when {ok} then '{good}' else 'FAIL' end as status,
  round(cast({value} as double), 6) as value from fig"""

    checks = [
        check("ready_windows", "samples > 100000", "samples"),
        check("ready_channels", "1 = 4", "1"),
        check("ready_length", "shortest = 1024 and longest = 1024", "longest"),
        check("ready_rate", "1 = 256", "1"),
        check("ready_precision", "false", "0"),
        check("ready_subjects", "subjects = 14", "subjects"),
        check("ready_eligible", "eligible >= 10", "eligible"),
        check("ready_share", "share between 0.001 and 0.05", "share"),
        check("ready_mode", "true", "1"),
        check("ready_mean", "abs(mu) < 0.1", "mu"),
        check("ready_std", "sd > 0", "sd"),
        check("rate", "1 = 256", "1"),
        check("shape", "shortest = 1024 and longest = 1024 and 1 = 4", "longest"),
        check("window", "false", "8"),
        check("stride", "false", "4"),
        check("channels", "false", "1"),
        check("normalisation", "true", "1"),
        check("window_mean", "abs(mu) < 0.01", "mu"),
        check("window_std", "sd > 0.4 and sd < 1.1", "sd"),
        check("sop", "true", "16", "WARN"),
        check("sph", "true", "5"),
        check("mode", "true", "1"),
        check("subjects", "subjects = 14", "subjects"),
        check("recordings", "recordings = 41", "recordings"),
        check("all_eligible", "eligible = subjects", "eligible"),
        check("share", "share between 0.03 and 0.2", "share"),
        check("precision", "false", "0"),
    ]
    union = " union all ".join(checks)
    return f"""{prepared()},
w as (select user_id % 10 as subject, user_id, y_far as y, len(x) as n, list_avg(x) as mu, list_stddev_pop(x) as sd from m),
people as (select subject, sum(y) as positive from w group by 1),
fig as (select count(*) as samples, avg(y) as share, (select count(*) from people) as subjects,
  (select count(*) from people where positive > 0) as eligible, count(distinct user_id) as recordings,
  min(n) as shortest, max(n) as longest, avg(mu) as mu, avg(sd) as sd from w),
checks as ({union})
select * from checks"""


def knn() -> str:
    return f"""with {VECTORS},
d as (
  select a.window_id, b.window_id as nb, b.y,
    sqrt(list_sum([(a.x[j] - b.x[j]) ** 2 for j in range(1, len(a.x) + 1)])) as dist
  from vectors a join vectors b on a.subject <> b.subject),
top as (
  select *, row_number() over (partition by window_id order by dist, nb) as rn from d
  qualify rn <= 3)
select window_id,
  round(case when min(dist) = 0 then avg(y) filter (where dist = 0)
    else sum(y / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) end, 6) as prob,
  cast(case when min(dist) = 0 then avg(y) filter (where dist = 0)
    else sum(y / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) end > 0.5 as int) as pred
from top group by 1"""


AUG_SHIFT = f"""case when {uniform('window_id', 1)} < 0.5 then
  [x[1 + ((j - cast(floor({uniform('window_id', 2)} * 100) - 50 as bigint)) % len(x) + len(x)) % len(x)]
    for j in range(len(x))] else x end"""
AUG_SCALE = f"""case when {uniform('window_id', 2)} < 0.5 then
  [v * (0.8::double + 0.4::double * {uniform('window_id', 3)}) for v in x] else x end"""

def first_tree(depth: int, bins: int) -> str:
    """Splits of one tree per fold by plain sums over (fold, node, feature, bin)."""
    cuts = ", ".join(f"{k / bins}" for k in range(1, bins))
    levels = []
    for d in range(depth):
        levels.append(f"""
s{d} as (
  select fold, node, j, b, sum(sum(0.5::double - y)) over w as gl, sum(sum(0.25::double)) over w as hl, sum(count(*)) over w as nl,
    sum(sum(0.5::double - y)) over t as g, sum(sum(0.25::double)) over t as h, sum(count(*)) over t as n
  from a{d} join binned using (window_id) group by fold, node, j, b
  window w as (partition by fold, node, j order by b), t as (partition by fold, node, j)),
b{d} as materialized (
  select *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) as gain from s{d}
  where b < {bins - 1} and hl >= 1 and h - hl >= 1
  qualify row_number() over (partition by fold, node order by gain desc, j, b) = 1 and gain > 1e-6),
a{d + 1} as (
  select a.fold, a.window_id, a.y, 2 * a.node + cast(p.b > s.b as int) as node
  from a{d} a join b{d} s on a.fold = s.fold and a.node = s.node
    join binned p on p.window_id = a.window_id and p.j = s.j)""")
    found = " union all ".join(f"select * from b{d}" for d in range(depth))
    return f"""with {VECTORS},
points as (select window_id, unnest(x) as v, unnest(range(len(x))) as j from vectors),
cuts as (select j, quantile_disc(v, [{cuts}]) as c from points group by j),
binned as materialized (select window_id, j, len(list_filter(c, lambda u: u < v)) as b from points join cuts using (j)),
folds as (select distinct subject as fold from vectors where y = 1),
a0 as (select fold, window_id, y, 1 as node from folds join vectors on subject <> fold),
{",".join(levels)}
select fold, cast(node as bigint) as node, cast(j as int) as feature, round(c[b + 1], 6) as cut, round(gain, 6) as gain,
  cast(nl as bigint) as n_left, cast(n - nl as bigint) as n_right
from ({found}) join cuts using (j)"""


ORACLES: dict[str, str] = {
    "record_index": """select 'pages_' || lpad(cast(row_number() over (order by url) - 1 as varchar), 6, '0')
        as record_id, url as path from (select distinct url from pages)""",
    "channel_normalise": f"""select {RAW} as ch_raw, {NAME} as channel, count(*) as n
        from events group by all""",
    "channel_select": f"""with c as (select distinct user_id, {NAME} as channel from events),
        p as (select user_id, channel, cast(list_position(['T7','T8','F7','F8','P7','P8'], channel) - 1 as int)
          as priority from c)
        select user_id, channel, priority from p
        qualify row_number() over (partition by user_id order by priority) <= 3""",
    "skipped_recordings": f"""with c as (select user_id,
          cast(count(distinct channel) filter (where channel in ('F8', 'P7')) as int) as n_channels
          from (select user_id, {NAME} as channel from events) group by 1)
        select user_id, n_channels, n_channels = 0 as skipped, n_channels = 2 as complete from c""",
    "recording_match": """with a as (
          select s_nationkey as subject, case s_suppkey % 3
            when 0 then replace(s_name, 'Supplier', 'Customer') || '.edf'
            when 1 then right(s_name, 3)
            else left(replace(s_name, 'Supplier', 'Customer'), 17) || '--.edf' end as recording
          from supplier),
        b as (select *, replace(replace(recording, '.edf', ''), '.EDF', '') as bare from a)
        select distinct subject, c_name as stem, recording
        from b join customer c on c.c_nationkey = b.subject
        where contains(recording, c_name) or contains(c_name, bare)
          or starts_with(c_name, rtrim(bare, '-'))""",
    "subject_lookup": """with ids as (select s, row_number() over (order by s) - 1 as subject_id
          from (select distinct s_nationkey as s from supplier))
        select c_nationkey as subject, subject_id, n_name, count(*) as n_records
        from customer left join ids on s = c_nationkey left join nation on n_nationkey = c_nationkey
        group by all""",
    "sliding_windows": cut_windows(16, 12, False),
    "sliding_windows_chunked": cut_windows(16, 4, True),
    "zscore": f"""with {SAMPLES} select event_id, channel,
        round((value - avg(value) over w) / (stddev_pop(value) over w + 1e-6), 6) as z
        from samples window w as (partition by user_id, channel)""",
    "minmax": f"""with {SAMPLES} select event_id, channel,
        round((value - min(value) over w) / (max(value) over w - min(value) over w + 1e-8), 6) as z
        from samples window w as (partition by user_id, channel)""",
    "window_zscore": f"""with {VECTORS}, s as (select window_id, x, list_avg(x) as m,
          sqrt(list_sum([(v - list_avg(x)) ** 2 for v in x]) / len(x)) as sd from vectors),
        z as (select window_id, [(v - m) / (sd + 1e-6) for v in x] as z from s)
        select window_id, {digest('z')} from z""",
    "downsample": f"""with {SAMPLES} select user_id, i // 2 as i, round(avg(value), 6) as value
        from samples group by all""",
    "trend_seasonal": f"""with {SAMPLES}, t as (select user_id, i, value, avg(value) over (
          partition by user_id order by i rows between 12 preceding and 12 following) as trend from samples)
        select user_id, i, round(trend, 6) as trend, round(value - trend, 6) as seasonal from t""",
    "siena_intervals": f"""with {LINES_SIENA},
        c as (select *, hour(stop) * 3600 + minute(stop) * 60 + second(stop) as off_s from lines),
        o as (select *, case when on_s < begin_s then on_s - begin_s + 86400 else on_s - begin_s end as onset,
          off_s - begin_s as stop_rel from c)
        select subject, 'PN0' || (cast(replace(subject, 'user', '') as bigint) % 10) || '-' || event_id || '.edf' as recording,
          cast(onset as double) as onset_sec,
          cast(case when stop_rel < onset then stop_rel + 86400 else stop_rel end as double) as offset_sec
        from o""",
    "chbmit_intervals": """with s as (select * from events where event_type = 'purchase' and value > 150
          and event_id % 4 <> 0)
        select 'user' || user_id as subject, 'chb' || event_id as recording,
          floor(value) * n as onset_sec, floor(value) * (n + 1) as offset_sec, floor(value) as duration_sec,
          13 * 3600 + 43 * 60 + 4 as start_clock, 14 * 3600 + 43 * 60 + 4 as end_clock
        from s, range(1, 3) as r(n)""",
    "seizure_counts": """select 'user' || user_id as subject,
          2 * count(*) filter (where event_id % 4 <> 0) as n_seizures
        from events where event_type = 'purchase' and value > 150 group by 1""",
    "label_detection": f"""with {SEIZURES}
        select w.user_id, w.window_id, cast(max(case when z.onset is not null and
          greatest(0, least(w.e, z.stop) - greatest(w.s, z.onset)) / 4.0 >= 0.2 then 1 else 0 end) as int) as y
        from wins w left join seizures z on w.user_id = z.user_id group by all""",
    "label_prediction": f"""with {LABELS} select user_id, window_id,
        cast(case when excluded = 1 then -1 else p15 end as int) as y from zoned""",
    "label_multi_sop": f"with {LABELS} select * from labelled",
    "label_merge": f"with {LABELS} select * from labelled",
    "class_balance": f"""with {LABELS} select user_id, count(*) as total, sum(y_sop15) as preictal,
          count(*) - sum(y_sop15) as interictal, cast(grouping(user_id) as int) as is_total,
          round(100.0::double * sum(y_sop15) / count(*), 6) as preictal_pct, sum(y_sop15) > 0 as loso_eligible
        from labelled group by rollup (user_id)""",
    "sop_table": f"""with {LABELS}, v as (select 'y_sop5' as variant, y_sop5 as y from labelled
          union all select 'y_sop10', y_sop10 from labelled union all select 'y_sop15', y_sop15 from labelled)
        select variant, count(*) as total, sum(y) as preictal, count(*) - sum(y) as interictal,
          round(100.0::double * sum(y) / count(*), 6) as preictal_pct from v group by 1""",
    "sop_table_by_subject": f"""with {LABELS}, v as (select user_id, 'y_sop5' as variant, y_sop5 as y from labelled
          union all select user_id, 'y_sop10', y_sop10 from labelled
          union all select user_id, 'y_sop15', y_sop15 from labelled)
        select user_id, variant, count(*) as total, sum(y) as preictal, count(*) - sum(y) as interictal,
          round(100.0::double * sum(y) / count(*), 6) as preictal_pct from v group by all""",
    "dataset_summary": f"""{_summary()} select samples, positive, negative,
        round(class_ratio, 6) as class_ratio, num_subjects, record_count from summary""",
    "structure_checks": f"""{_summary()}, {CHECKS}
        select "check", status, round(value, 6) as value from checks""",
    "channel_correlation": f"""with {CHANNELS},
        pts as (select window_id, y, ch, p, x[p + 1] as v from chans, range(16) as r(p)),
        c as (select a.window_id, a.y, a.ch as ch_a, b.ch as ch_b, corr(a.v, b.v) as r
          from pts a join pts b on a.window_id = b.window_id and a.p = b.p and a.ch < b.ch group by all),
        m as (select ch_a, ch_b, avg(r) filter (where y = 0) as i, avg(r) filter (where y = 1) as p
          from c group by all)
        select ch_a, ch_b, round(i, 6) as interictal, round(p, 6) as preictal, round(p - i, 6) as delta from m""",
    "norm_audit": f"""with {CHANNELS}, s as (select ch, list_avg(x) as m,
          sqrt(list_sum([(v - list_avg(x)) ** 2 for v in x]) / len(x)) as sd from chans)
        select ch, count(*) as n, round(avg(m), 6) as mean_of_means, round(avg(sd), 6) as mean_of_stds,
          round(max(abs(m)), 6) as max_abs_mean from s group by 1""",
    "class_weights": f"""with {VECTORS}, c as (select y, count(*) as n from vectors group by 1)
        select y, n, round((select count(*) from vectors)
          / ((select count(*) from c) * n)::double, 6) as weight from c""",
    "sample_weights": f"""with {VECTORS} select window_id, y, round(count(*) over ()
          / ((select count(distinct y) from vectors) * count(*) over (partition by y))::double, 6) as weight
        from vectors""",
    "binary_weights": f"""with {FLAT}, c as (select fold, count(*) filter (where y = 0) as n_neg,
          count(*) filter (where y = 1) as n_pos from flat group by 1)
        select fold, n_neg, n_pos, round((n_neg + n_pos) / (2.0::double * n_neg), 6) as w_neg,
          round((n_neg + n_pos) / (2.0::double * n_pos), 6) as w_pos,
          round(n_neg / greatest(n_pos, 1)::double, 6) as neg_pos_ratio from c""",
    "score_decisions": """select event_id, round(1 / (1 + exp(-2 * (value - 50) / 50)), 6) as prob,
        cast(1 / (1 + exp(-(value - 50) / 50 - (value - 50) / 50)) >= 0.5 as int) as pred from events""",
    "segment_metrics": f"""with {FLAT}, c as (select user_id, {COUNTS} from flat group by 1)
        select user_id, tp, tn, fp, fn, {rates()} from c""",
    "auc_roc": f"""with {FLAT} select n_pos, n_neg, round(auc_roc, 6) as auc_roc from {auc('flat', '')}""",
    "auc_roc_by_fold": f"""with {FLAT} select fold, n_pos, n_neg, round(auc_roc, 6) as auc_roc
        from {auc('flat', 'fold')}""",
    "threshold_sweep": f"""with {SWEEP} select round(threshold, 6) as threshold, tp, tn, fp, fn, {rates()},
        (select round(auc_roc, 6) from {auc('flat', '')}) as auc_roc from c""",
    "threshold_sweep_voted": VOTED_SWEEP,
    "threshold_sweep_callable": VOTED_SWEEP,
    "operating_point": f"""with {SWEEP}, h as (select *, fp / ((tp + tn + fp + fn) * 4.0::double / 3600.0) as fp_h,
          {div('tp', '(tp + fn)')} as rec from c)
        select round(threshold, 6) as threshold, tp, tn, fp, fn, {rates()}, round(fp_h, 6) as fp_h
        from h where fp_h <= 200 order by rec desc, threshold limit 1""",
    "loso_summary": f"""with {FLAT}, c as (select fold, {COUNTS} from flat group by 1),
        m as (select {rates(wrap='{}')} from c)
        select count(*) as n_folds, {means(METRICS)} from m""",
    "full_evaluation": f"""with {SAMPLES}, scored as (
          select user_id, user_id % 10 as fold, i as k,
            cast(event_type in ('error', 'purchase') as int) as y,
            1 / (1 + exp(-(value - 50) / 50 - (value - 50) / 50)) as prob,
            cast(1 / (1 + exp(-(value - 50) / 50 - (value - 50) / 50)) >= 0.5 as int) as pred
          from samples),
        c as (select fold, {COUNTS} from scored group by 1),
        a as (select * from {auc('scored', 'fold')}),
        e as ({{events}})
        select cast(c.fold as int) as fold, tp, tn, fp, fn, {rates()}, round(auc_roc, 6) as auc_roc,
          n_detected, n_seizures, n_false_alarms, n_windows, hours, detection_rate, fp_per_hour
        from c join a using (fold) join e using (fold)""",
    "loso_event_summary": f"""with e as ({event_metrics('fold', 'scored', 4.0, 'first').replace('round(', '(').replace(', 6)', ')')})
        select count(*) as n_folds, {means(('fp_per_hour', 'detection_rate', 'hours'))} from e""",
    "ensemble_quantile": """with m as (select event_id, value / (value + 50) as p from events
          union all select event_id, (event_id % 100) / 100.0::double from events
          union all select event_id, (user_id % 10) / 10.0::double from events)
        select event_id, round(quantile_cont(p, 0.6), 6) as prob, count(*) as n_models from m group by 1""",
    "loss_metrics": LOSSES,
    "majority_vote": f"with {SCORED}, {vote('scored', 3, 2, 'v')} select user_id, k, pred from v",
    "majority_vote_even": f"with {SCORED}, {vote('scored', 4, 3, 'v')} select user_id, k, pred from v",
    "ema": f"""with {SCORED},
        l as (select user_id, list(prob order by k) as ps from scored group by 1),
        s as (select user_id, k, list_reduce(ps[1 : k + 1], lambda a, p: 0.3::double * p + 0.7::double * a) as ema
          from scored join l using (user_id))
        select user_id, k, round(ema, 6) as ema, cast(ema >= 0.5 as int) as ema_pred from s""",
    "collar_merge": f"with {SCORED}, {bridge('scored', 3, 'v')} select user_id, k, pred from v",
    "alarm_runs": f"with {SCORED}, {runs('scored', 'pred', 'v')} select user_id, start_k, end_k from v",
    "event_metrics": event_metrics("user_id", "scored", 4.0, "first"),
    "event_metrics_any": event_metrics("", "scored", 1.0, "any"),
    "vote_then_merge": f"""with {SCORED}, {vote('scored', 3, 2, 'v')}, {bridge('v', 3, 'b')}
        select user_id, k, pred from b""",
    "alarm_events": event_metrics(
        "", "b", 4.0, "first", f"{SCORED}, {vote('scored', 3, 2, 'v')}, {bridge('v', 3, 'b')}"
    ),
    "dwt_level1": f"""with {VECTORS}, {levels('vectors', 1)}
        select window_id, 'approx' as band, {digest('a1')} from lev1
        union all select window_id, 'detail', {digest('d1')} from lev1""",
    "dwt_level2": f"""with {VECTORS}, {levels('vectors', 2)}
        select window_id, 'approx' as band, {digest('a2')} from lev2
        union all select window_id, 'detail', {digest('d2')} from lev2""",
    "dwt_bands": f"""with {VECTORS}, {levels('vectors', 3)}
        select window_id, 0 as band, {digest('a3')} from lev3
        union all select window_id, 1, {digest('d3')} from lev3
        union all select window_id, 2, {digest('d2')} from lev2
        union all select window_id, 3, {digest('d1')} from lev1""",
    "band_stats": f"""with {VECTORS}, {stats('vectors')}
        select window_id, round(mn, 6) as min, round(mx, 6) as max, round(mu, 6) as mean, round(m2, 6) as var,
          round(sqrt(m2), 6) as std, round(m3 / m2 ** 1.5, 6) as skewness,
          round(m4 / m2 ** 2 - 3, 6) as kurtosis from stats""",
    "sample_entropy": f"""with {VECTORS}, {entropies('vectors')}
        select window_id, round(entropy, 6) as entropy from sampen""",
    "permutation_entropy": f"""with {VECTORS}, {entropies('vectors')}
        select window_id, round(entropy, 6) as entropy from perment""",
    "shannon_entropy": f"""with {VECTORS}, {entropies('vectors')}
        select window_id, round(entropy, 6) as entropy from shannon""",
    "dwt_subbands_sum": f"""with {VECTORS} select window_id, p as t, round(x[p + 1], 6) as v
        from vectors, range(64) as r(p)""",
    "psd": f"""with {psd()} select ch, y, bin, round(freq, 6) as freq,
        round(mean_power, 9) as mean_power, round(std_power, 9) as std_power from spectrum""",
    "band_power": f"""with {psd()}, b as (
          select *, case when freq >= 0.5 and freq < 4 then 'delta' when freq >= 4 and freq < 8 then 'theta'
            when freq >= 8 and freq < 13 then 'alpha' when freq >= 13 and freq < 30 then 'beta'
            when freq >= 30 and freq < 45 then 'gamma' end as band from spectrum),
        s as (select ch, y, band, (lead(freq) over w - freq) * (lead(mean_power) over w + mean_power) / 2 as area
          from b where band is not null window w as (partition by ch, y, band order by freq))
        select ch, y, band, round(coalesce(sum(area), 0.0), 9) as power from s group by all""",
    "time_shift": f"""with {VECTORS}, s as (select window_id, {AUG_SHIFT} as x from vectors)
        select window_id, {digest('x')} from s""",
    "amplitude_scale": f"""with {VECTORS}, s as (select window_id, {AUG_SCALE} as x from vectors)
        select window_id, {digest('x')} from s""",
    "augment_compose": f"""with {VECTORS}, s as (select window_id, {AUG_SHIFT} as x from vectors),
        t as (select window_id, {AUG_SCALE} as x from s)
        select window_id, {digest('x')} from t""",
    "channel_dropout": f"""with {CHANNELS}, s as (select window_id, ch, case when {uniform('window_id', 3)} < 0.5
          and ch = floor({uniform('window_id', 4)} * 4) then [0.0::double for v in x] else x end as x from chans)
        select window_id, ch, {digest('x')} from s""",
    "gaussian_noise": f"""with {VECTORS}, e as (
          select window_id, i, x[i] as v, cast(window_id as varchar) || ':' || cast(i as varchar) as place
          from (select window_id, x, unnest(range(1, len(x) + 1)) as i from vectors)),
        s as (select window_id, i, case when {uniform('window_id', 4)} < 0.5 then
          v + 0.01::double * sqrt(-2 * ln(1 - {uniform('place', 5)})) * cos(2 * pi() * {uniform('place', 6)}) else v end as v from e)
        select window_id, count(*) as n, round(sum(v), 6) as total, round(sum(v * i), 6) as weighted
        from s group by window_id""",
    "loso_folds": f"""with {VECTORS}, c as (select subject as fold, count(*) as n_test, sum(y) as pos_test
          from vectors group by 1), t as (select count(*) as n, sum(y) as p from vectors)
        select fold, n - n_test as n_train, n_test, p - pos_test as pos_train, pos_test
        from c, t where pos_test > 0 and p - pos_test > 0 and p - pos_test < n - n_test""",
    "kfold": f"with {VECTORS}, {PLACED} select window_id, y, cast(pos % 5 as int) as fold from placed",
    "stratified_split": f"""with {VECTORS}, {PLACED} select window_id, y,
        case when pos < floor(n * 0.2::double + 0.5) then 'test'
          when pos < floor(n * 0.2::double + 0.5) + floor(n * 0.1::double + 0.5) then 'val' else 'train' end as role
        from placed""",
    "subject_cap": f"""with {VECTORS} select window_id, subject from vectors
        where subject in (select distinct subject from vectors order by 1 limit 2)""",
    "row_cap": f"""with {VECTORS} select window_id, subject from vectors
        order by {key('window_id', 42)}, window_id limit 50""",
    "undersample": f"""with {VECTORS}, {PLACED} select window_id, y from placed
        where y = 1 or pos < 3 * (select count(*) from vectors where y = 1)""",
    "per_class_pick": f"with {VECTORS}, {PLACED} select window_id, y from placed where pos < 40",
    "weighted_sample": f"""with {VECTORS}, {PLACED},
        c as (select row_number() over (order by y) - 1 as ci, y, count(*) as n from vectors group by y),
        d as (select i as draw, floor({uniform('i', 43)} * (select count(*) from c)) as ci,
          {uniform('i', 44)} as u from range((select count(*) from vectors)) as r(i)),
        e as (select draw, y, floor(u * n) as pos from d join c using (ci))
        select draw, window_id, y from e join placed using (y, pos)""",
    "knn": knn(),
    "knn_loso": f"""with v as ({knn().replace('round(', '(').replace(', 6)', ')')}),
        {VECTORS}, s as (select subject as fold, vectors.y, v.prob, v.pred from v join vectors using (window_id)),
        c as (select fold, {COUNTS} from s group by 1), a as (select * from {auc('s', 'fold')})
        select fold, tp, tn, fp, fn, {rates()}, n_pos as n_pos_test, n_neg as n_neg_test,
          round(auc_roc, 6) as auc_roc from c join a using (fold)""",
    "knn_loso_summary": f"""with v as ({knn().replace('round(', '(').replace(', 6)', ')')}),
        {VECTORS}, s as (select subject as fold, vectors.y, v.prob, v.pred from v join vectors using (window_id)),
        c as (select fold, {COUNTS} from s group by 1), a as (select * from {auc('s', 'fold')}),
        m as (select {rates(wrap='{}')}, auc_roc from c join a using (fold))
        select count(*) as n_folds, {means((*METRICS, 'auc_roc'))} from m""",
    "experiment_grid": f"""with {LABELS}, v as (
          select 'y_sop5' as dataset, count(*) as total, sum(y_sop5) as preictal from labelled
          union all select 'y_sop10', count(*), sum(y_sop10) from labelled
          union all select 'y_sop15', count(*), sum(y_sop15) from labelled)
        select dataset, total, preictal, rep, model, rep + 42 as seed from v, range(2) as r(rep),
          unnest(['svm_rbf', 'svm_linear', 'random_forest', 'xgboost', 'lightgbm', 'knn']) as m(model)""",
    "ablation_grid": f"""with c as (select user_id, list(distinct {NAME}) as has from events group by 1),
        g as (select * from (values ('two', ['T7', 'T8']), ('four', ['F7', 'F8', 'T7', 'T8']),
            ('six', ['T7', 'T8', 'F7', 'F8', 'P7', 'P8'])) as s(channel_set, needs),
          unnest([2.0::double, 4, 8, 16]) as w(window_sec),
          unnest(['zscore+bandpass', 'bandpass', 'zscore']) as p(preprocessing))
        select channel_set, window_sec, preprocessing, count(*) as recordings,
          count(*) filter (where list_has_all(has, needs)) as usable from c, g group by all""",
    "dataset_roundtrip": f"""with {LABELS} select user_id % 10 as subject, count(*) as n,
        sum(y_sop10) as positives from labelled group by 1""",
    "dataset_validation": f"""with {LABELS} select count(*) as samples, count(distinct user_id % 10) as subjects,
          sum(y_sop5) as y_sop5_positive, sum(y_sop10) as y_sop10_positive, sum(y_sop15) as y_sop15_positive,
          round(avg(y_sop5), 6) as y_sop5_ratio, round(avg(y_sop10), 6) as y_sop10_ratio,
          round(avg(y_sop15), 6) as y_sop15_ratio, 'x_dwt' as missing, false as valid from labelled""",
    "stream_windows": """with w as (
          select user_id, date_trunc('second', ts) - to_seconds(s) as w_start, value
          from events, range(4) as r(s)),
        g as (select user_id, w_start, w_start + interval 4 seconds as w_end, count(*) as n,
          round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std,
          round(min(value), 6) as low, round(max(value), 6) as high from w group by all)
        select * from g where w_end <= (select date_trunc('millisecond', max(ts)) from events) - interval 10 seconds""",
    "stream_ema": f"""with {SCORED},
        l as (select user_id, list(prob order by k) as ps from scored group by 1),
        s as (select user_id, k, list_reduce(ps[1 : k + 1], lambda a, p: 0.3::double * p + 0.7::double * a) as ema
          from scored join l using (user_id))
        select user_id, k, round(ema, 6) as ema, cast(ema >= 0.5 as int) as ema_pred from s""",
    "stream_alarm": f"""with {SCORED} select user_id, k, cast(count(*) over w = 3 and sum(pred) over w = 3 as int) as alarm
        from scored window w as (partition by user_id order by k rows between 2 preceding and current row)""",
    "feature_vector": feature_vector(LONG, 4, 1024),
    "stored_features": feature_vector(CHANNELS, 1),
    "dwt_subbands": subbands(4),
    "prepare_dataset": prepare_dataset(),
    "conformance": conformance(),
    "conformance_counts": conformance().replace("select * from checks", "select status, count(*) as n from checks group by 1"),
    "dwt_filter": dwt_filter(),
    "iir_filter": iir_filter(),
}


def _full_evaluation() -> str:
    body = event_metrics("fold", "scored", 4.0, "first", "scored as (select * from scored)")
    events = body.replace("with scored as (select * from scored),", "with", 1)
    return ORACLES["full_evaluation"].replace("{events}", events)


ORACLES["full_evaluation"] = _full_evaluation()


for twin, name in {
    "windows_small_chunks": "sliding_windows_chunked",
    "iir_small_chunks": "iir_filter",
    "dwt_filter_small_chunks": "dwt_filter",
    "vote_small_chunks": "majority_vote",
    "collar_small_chunks": "collar_merge",
    "ema_small_chunks": "ema",
    "runs_small_chunks": "alarm_runs",
    "knn_stored": "knn",
    "stored_annotations": "siena_intervals",
}.items():
    ORACLES[twin] = ORACLES[name]

ORACLES |= {
    "discovered_records": f"with {VECTORS} select distinct cast(subject as bigint) as subject, true as found from vectors",
    "stored_samples": f"""with {SAMPLES} select cast(user_id % 10 as varchar) as subject, channel, count(*) as n,
        round(sum(value), 6) as total from samples where channel in ('F7', 'T7') group by all""",
    "results_table": f"""with v as ({ORACLES["sop_table"]})
        select 'first' as experiment, variant, total, null as preictal from v
        union all select 'second', variant, total, preictal from v""",
    "loso_json": f"""with {FLAT}, c as (select fold, {COUNTS} from flat group by 1),
        m as (select {rates(wrap='{}')} from c)
        select 'scores' as model, count(*) as n_folds, round(avg(recall), 6) as recall,
          round(stddev_pop(f1), 6) as f1_spread, round(max(recall), 6) as best_recall from m""",
    "metadata_json": f"""{_summary()},
        people as (select distinct user_id % 10 as s from labelled),
        names as (select '{{' || string_agg('"' || id || '":"' || s || '"', ',' order by id) || '}}' as j
          from (select s, row_number() over (order by s) - 1 as id from people)),
        has as (select user_id, count(*) filter (where {NAME} in ('F8', 'P7')) as c from events group by 1)
        select 'events' as dataset, samples, positive, negative, round(class_ratio, 6) as class_ratio, num_subjects,
          record_count, 256 as sample_rate_hz, 1024 as seq_len, 4.0::double as window_sec, 1.0::double as stride_sec,
          4 as channels, 'zscore' as normalization, (select count(*) from has where c = 0) as skipped_no_channels,
          'F7,F8,T7,T8' as selected_channels, j as subject_map, 'prediction' as mode, 0.2::double as overlap_fraction,
          900.0::double as sop_minutes, 300.0::double as sph_minutes, 900.0::double as postictal_gap_minutes,
          (select sum(y_sop5) from labelled) as positive_y_sop5, (select sum(y_sop10) from labelled) as positive_y_sop10,
          (select sum(y_sop15) from labelled) as positive_y_sop15,
          5.0::double as minutes_y_sop5, 10.0::double as minutes_y_sop10, 15.0::double as minutes_y_sop15
        from summary, names""",
    "merged_dataset": f"""with feats as ({feature_vector(CHANNELS, 1)}), {VECTORS}
        select v.subject, v.window_id, v.y as y_first, cast(v.window_id % 3 = 0 as int) as y_third, {digest('v.x')},
          f.n as f_n, f.total as f_total, f.weighted as f_weighted
        from vectors v join feats f using (window_id)""",
    "inner_split": f"""with {VECTORS}, folds as (select distinct subject as fold from vectors where y = 1),
        train as (select fold, vectors.* from folds join vectors on subject <> fold),
        p as (select fold, y, row_number() over (partition by fold, y order by {key('window_id', 42)}, window_id) - 1 as pos,
          count(*) over (partition by fold, y) as n from train)
        select fold, y, case when pos < floor(n * 0.1::double + 0.5) then 'val' else 'train' end as role, count(*) as n
        from p group by all""",
    "stream_vote": ORACLES["majority_vote"],
    "stream_vote_reversed": ORACLES["majority_vote"],
    "stream_parity": ORACLES["stream_ema"],
    "stream_late_rows": """with days as (select distinct cast(ts as date) as d from events),
        parts as (select d, ntile(3) over (order by d) as part from days),
        e as (select user_id, event_id, d, part from events join parts on cast(ts as date) = d),
        a as (select user_id, max(d) as answered from e
          where part >= 2 and d + interval 1 day <= (select max(ts) from events) - interval 60 seconds group by user_id)
        select user_id, event_id, coalesce(part = 1 and d <= answered, false) as late from e left join a using (user_id)""",
    "gbt_first_tree": first_tree(3, 16),
}
