"""Registered queries: operators applied to the tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.rolling import ordered
from tickforge.operators import backtest, bars, bet_sizing, breaks, codependence, entropy, features, filters, labeling, online, portfolio, sampling
from tickforge.sources.ticks import EVENT_TICKS, PANEL, event_ticks, panel

QUERIES: dict = {}
ORACLES: dict = {}
TICKS, SLOT_HOURS = 10, 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def tick_bars_of(spark, sf_dir):
    """Ten-tick bars of the events; seq is the bar's number and dollar its turnover."""
    b = bars.tick_bars(event_ticks(spark, sf_dir), TICKS)
    return b.withColumns({"ts": F.col("date_time"), "seq": F.col("bar_id"), "dollar": F.col("cum_dollar_value")})


SIGNED = f"""{EVENT_TICKS},
moved as (select *, price - lag(price) over (partition by symbol order by ts, seq) as d, row_number() over (partition by symbol order by ts, seq) as tick_num from ticks),
signed as (
  select *, coalesce(last_value(case when d <> 0 then sign(d)::double end ignore nulls)
    over (partition by symbol order by ts, seq rows between unbounded preceding and current row), 0) as sgn
  from moved)"""


def summary(source: str, key: str) -> str:
    return f"""select symbol, {key}, max(ts) as date_time, max(tick_num) as tick_num, first(price order by ts, seq) as open,
    max(price) as high, min(price) as low, last(price order by ts, seq) as close, sum(volume) as volume,
    sum(case when sgn > 0 then volume else 0 end) as cum_buy_volume, count(*) as cum_ticks, sum(price * volume) as cum_dollar_value
  from {source} group by symbol, {key}"""


BARS = f"""{SIGNED},
numbered as (select *, (tick_num - 1) // {TICKS} as bar_id from signed),
bars as ({summary('numbered', 'bar_id')} having count(*) = {TICKS}),
b as (select *, date_time as ts, bar_id as seq, cum_dollar_value as dollar from bars)"""
W = "over (partition by symbol order by ts, seq)"


def last_n(n: int) -> str:
    return f"over (partition by symbol order by ts, seq rows between {n - 1} preceding and current row)"


def full(agg: str, x: str, n: int) -> str:
    return f"case when count({x}) {last_n(n)} >= {n} then {agg}({x}) {last_n(n)} end"


def normal_cdf_sql(z: str) -> str:
    """The expression of functions.rolling.normal_cdf, as SQL."""
    def poly(coefficients):
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * abs({z}) + {c!r})"
        return out

    top = poly([3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376])
    low = poly([8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752])
    tail = f"(abs({z}) + 1 / (abs({z}) + 2 / (abs({z}) + 3 / (abs({z}) + 4 / (abs({z}) + 0.65)))))"
    upper = f"case when abs({z}) > 37 then 0.0::double when abs({z}) < 7.07106781186547 then exp(-{z} * {z} / 2) * {top} / {low} else exp(-{z} * {z} / 2) / {tail} / 2.506628274631 end"
    return f"(case when {z} > 0 then 1 - ({upper}) else ({upper}) end)"


# Bars ------------------------------------------------------------------------------------------------

COLUMNS = ["symbol", "bar_id", "date_time", "tick_num", "open", "high", "low", "close", "volume", "cum_buy_volume", "cum_ticks", "cum_dollar_value"]


@query(f"with {BARS} select {', '.join(COLUMNS)} from bars")
def tick_bars(spark, sf_dir):
    return bars.tick_bars(event_ticks(spark, sf_dir), TICKS).select(*COLUMNS)


@query(f"""with {SIGNED}, slotted as (select *, epoch_us(ts) // 86400000000 as slot from signed),
bars as ({summary('slotted', 'slot')}), ranked as (select *, row_number() over (partition by symbol order by slot) - 1 as bar_id,
  max(slot) over (partition by symbol) as last from bars)
select symbol, bar_id, make_timestamp((slot + 1) * 86400000000) as date_time, {', '.join(COLUMNS[3:])} from ranked where slot < last""")
def time_bars(spark, sf_dir):
    return bars.time_bars(event_ticks(spark, sf_dir), "D", 1).select(*COLUMNS)


def recursive_bars(metric: str, threshold: float) -> str:
    return f"""with recursive {SIGNED},
walk(symbol, k, bar_id, acc) as (
  select distinct symbol, 0::bigint, 0::bigint, 0::double from signed
  union all
  select s.symbol, s.tick_num, case when w.acc >= {threshold} then w.bar_id + 1 else w.bar_id end,
    case when w.acc >= {threshold} then 0 else w.acc end + s.m
  from walk w join (select *, {metric} as m from signed) s on s.symbol = w.symbol and s.tick_num = w.k + 1),
closed as (select symbol, bar_id from walk group by symbol, bar_id having max(acc) >= {threshold}),
placed as (select s.*, w.bar_id from signed s join walk w on w.symbol = s.symbol and w.k = s.tick_num join closed c on c.symbol = w.symbol and c.bar_id = w.bar_id)
{summary('placed', 'bar_id')}"""


@query(recursive_bars("volume", 2000.0))
def volume_bars(spark, sf_dir):
    return bars.standard_bars(event_ticks(spark, sf_dir), "volume", 2000.0).select(*COLUMNS)


@query(recursive_bars("price * volume", 100000.0))
def dollar_bars(spark, sf_dir):
    return bars.standard_bars(event_ticks(spark, sf_dir), "dollar", 100000.0).select(*COLUMNS)


@query(f"""with recursive {SIGNED}, half as (select min(ts) as a, min(ts) + (max(ts) - min(ts)) / 2 as m from ticks),
thr as (select s.*, case when ts >= half.m then 50000.0 else 100000.0 end as t from signed s, half),
walk(symbol, k, bar_id, acc, t) as (
  select distinct symbol, 0::bigint, 0::bigint, 0::double, 1e18::double from thr
  union all
  select s.symbol, s.tick_num, case when w.acc >= w.t then w.bar_id + 1 else w.bar_id end, case when w.acc >= w.t then 0 else w.acc end + s.price * s.volume, s.t::double
  from walk w join thr s on s.symbol = w.symbol and s.tick_num = w.k + 1),
closed as (select symbol, bar_id from walk where acc >= t),
placed as (select s.*, w.bar_id from signed s join walk w on w.symbol = s.symbol and w.k = s.tick_num join closed c on c.symbol = w.symbol and c.bar_id = w.bar_id)
{summary('placed', 'bar_id')}""")
def dollar_bars_stepped(spark, sf_dir):
    t = event_ticks(spark, sf_dir)
    steps = t.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.array(
        F.struct(F.col("a").alias("ts"), F.lit(100000.0).alias("threshold")),
        F.struct((F.col("a") + (F.col("b") - F.col("a")) / 2).alias("ts"), F.lit(50000.0).alias("threshold")),
    )).alias("s")).select("s.*")
    return bars.standard_bars(t, "dollar", steps).select(*COLUMNS)


def _information(kind: str, metric: str, make):
    def run(spark, sf_dir):
        return make(event_ticks(spark, sf_dir), metric, kind, num_prev_bars=3, expected_imbalance_window=200, exp_num_ticks_init=50, exp_num_ticks_constraints=[10, 500] if kind == "ema" else None).select(*COLUMNS)

    return run


for _kind in ("ema", "const"):
    for _metric in ("dollar", "volume", "ticks"):
        QUERIES[f"{_kind}_{_metric}_imbalance_bars"] = _information(_kind, _metric, bars.imbalance_bars)
        QUERIES[f"{_kind}_{_metric}_run_bars"] = _information(_kind, _metric, bars.run_bars)


# Event sampling and labels ---------------------------------------------------------------------------


@query(f"""with {EVENT_TICKS}, x as (select *, {full('avg', 'price', 20)} + 1.0 * {full('stddev_samp', 'price', 20)} as lvl from ticks)
select symbol, ts, seq, price from x where price >= lvl""")
def z_score_filter(spark, sf_dir):
    return filters.z_score_filter(event_ticks(spark, sf_dir), 20, 20, 1.0, "price").select("symbol", "ts", "seq", "price")


@query(f"""with recursive {BARS},
r as (select *, ln(close / lag(close) {W}) as ret, row_number() {W} as k from b),
walk(symbol, k, up, down, hit) as (
  select distinct symbol, 1::bigint, 0::double, 0::double, 0 from r
  union all
  select r.symbol, r.k,
    case when not (least(0, w.down + r.ret) < -0.5) and greatest(0, w.up + r.ret) > 0.5 then 0 else greatest(0, w.up + r.ret) end,
    case when least(0, w.down + r.ret) < -0.5 then 0 else least(0, w.down + r.ret) end,
    case when least(0, w.down + r.ret) < -0.5 or greatest(0, w.up + r.ret) > 0.5 then 1 else 0 end
  from walk w join r on r.symbol = w.symbol and r.k = w.k + 1)
select r.symbol, r.ts, r.seq from walk w join r on r.symbol = w.symbol and r.k = w.k where w.hit = 1""")
def cusum_filter(spark, sf_dir):
    return filters.cusum_filter(tick_bars_of(spark, sf_dir), 0.5)


@query(f"""with {PANEL}, p as (select ts, asset, lead(price) over (partition by asset order by ts) / price - 1 as ret from panel)
select ts, asset, ret from p""")
def raw_return(spark, sf_dir):
    return labeling.raw_return(panel(spark, sf_dir))


@query(f"""with {PANEL}, p as (select ts, asset, lead(price) over (partition by asset order by ts) / price - 1 as ret from panel),
z as (select *, count(ret) over v as n, avg(ret) over v as m, stddev_samp(ret) over v as s from p window v as (partition by asset order by ts rows between 9 preceding and current row))
select ts, asset, case when n < 10 or ret is null then null when (ret - m) / s > 1 then 1 when (ret - m) / s < -1 then -1 else 0 end as label from z""")
def fixed_time_horizon(spark, sf_dir):
    return labeling.fixed_time_horizon(panel(spark, sf_dir), 1.0, 10)


@query(f"""with {PANEL}, p as (select ts, asset, lead(price) over (partition by asset order by ts) / price - 1 as ret from panel)
select ts, asset, ret - avg(ret) over (partition by ts) as ret from p""")
def excess_over_mean(spark, sf_dir):
    return labeling.excess(panel(spark, sf_dir), "mean")


@query(f"""with {PANEL}, p as (select ts, asset, lead(price) over (partition by asset order by ts) / price - 1 as ret from panel)
select ts, asset, ret - median(ret) over (partition by ts) as ret from p""")
def excess_over_median(spark, sf_dir):
    return labeling.excess(panel(spark, sf_dir), "median")


@query(f"""with {PANEL}, p as (select ts, asset, lead(price) over (partition by asset order by ts) / price - 1 as ret from panel)
select ts, asset, sign(ret - 0.01)::double as ret from p""")
def return_over_benchmark(spark, sf_dir):
    return labeling.over_benchmark(panel(spark, sf_dir), 0.01, binary=True)


@query(f"""with {PANEL}, p as (select ts, asset, ln(price / lag(price) over (partition by asset order by ts)) as x from panel),
r as (select ts, asset, row_number() over (partition by ts order by x, asset) as k, count(*) over (partition by ts) as n from p where x is not null)
select ts, asset, case when k > 1 + (n - 1) * 2 / 3 then 1 when k <= 1 + (n - 1) / 3 then -1 else 0 end as label from r""")
def tail_sets(spark, sf_dir):
    return labeling.tail_sets(panel(spark, sf_dir), 3)


def barrier_events(spark, sf_dir):
    """Every bar is an event with the barrier two days on, a target of 0.5 and alternating sides."""
    b = tick_bars_of(spark, sf_dir).where("close > 0").select("symbol", "ts", "seq", "close").localCheckpoint()  # read many times
    e = b.select("symbol", F.col("seq").alias("event_id"), F.col("ts").alias("t0"), F.lit(0.5).alias("trgt"), F.when(F.col("seq") % 2 == 0, 1.0).otherwise(-1.0).alias("side"))
    return labeling.add_vertical_barrier(e, b, days=2), b


EVENTS = f"""{BARS}, c as (select * from b where close > 0),
e0 as (select symbol, seq as event_id, ts as t0, 0.5::double as trgt, case when seq % 2 = 0 then 1.0 else -1.0 end::double as side from c),
e as (select e0.*, (select min(c.ts) from c where c.symbol = e0.symbol and c.ts >= e0.t0 + interval 2 day) as t1 from e0),
ev as (select * from e where t1 is not null)"""
TOUCHED = f"""{EVENTS},
path as (select ev.*, c.ts, (c.close / first_value(c.close) over (partition by ev.symbol, event_id order by c.ts) - 1) * side as r
  from ev join c on c.symbol = ev.symbol and c.ts between t0 and t1),
touched as (select symbol, event_id, t0, trgt, side, t1 as v, min(case when r > 1.0 * trgt then ts end) as pt_at, min(case when r < -1.0 * trgt then ts end) as sl_at
  from path group by all)"""


@query(f"with {EVENTS} select symbol, event_id, t0, t1 from ev")
def vertical_barrier(spark, sf_dir):
    return barrier_events(spark, sf_dir)[0].select("symbol", "event_id", "t0", "t1")


@query(f"with {TOUCHED} select symbol, event_id, t0, least(v, coalesce(pt_at, v), coalesce(sl_at, v)) as t1, pt_at, sl_at from touched")
def triple_barrier(spark, sf_dir):
    e, close = barrier_events(spark, sf_dir)
    return labeling.triple_barrier(e, close, 1.0, 1.0).select("symbol", "event_id", "t0", "t1", "pt_at", "sl_at")


@query(f"""with {TOUCHED}, f as (select *, least(v, coalesce(pt_at, v), coalesce(sl_at, v)) as t1 from touched),
g as (select f.*, (ln(b1.close) - ln(b0.close)) * side as r from f join c b0 on b0.symbol = f.symbol and b0.ts = f.t0 join c b1 on b1.symbol = f.symbol and b1.ts = f.t1)
select symbol, event_id, exp(r) - 1 as ret, case when r <= 0 then 0 when r > ln(1 + trgt) then 1 else 0 end as bin from g""")
def barrier_bins(spark, sf_dir):
    e, close = barrier_events(spark, sf_dir)
    return labeling.get_bins(labeling.triple_barrier(e, close, 1.0, 1.0), close).select("symbol", "event_id", "ret", "bin")


@query(f"""with {BARS}, rows as (select symbol, ts, seq, close, list(close) over v as y, list(ts) over v as t from b
  window v as (partition by symbol order by ts, seq rows between current row and 9 following)),
ks as (select r.symbol, r.ts, r.seq, r.close, k, y[1:k] as y, t[k] as t1 from rows r, (select unnest([5, 6, 7, 8, 9]) as k) where len(y) = 10),
flat as (select symbol, ts, seq, close, k, t1, y[k] as yk, unnest(y) as v, generate_subscripts(y, 1) - 1 as i from ks),
fit as (select symbol, ts, seq, close, k, t1, yk, regr_slope(v, i) as s, sum(v * v) - count(*) * avg(v) * avg(v) as syy from flat group by all),
tv as (select *, k * (k * k - 1) / 12.0 as sxx, syy - s * s * k * (k * k - 1) / 12.0 as sse from fit),
best as (select *, s / sqrt(sse / (k - 2) / sxx) as t from tv where sse > 1e-9),
ranked as (select *, row_number() over (partition by symbol, ts, seq order by abs(t) desc, k) as p from best)
select symbol, ts, seq, t1, t as tvalue, yk / close - 1 as ret, sign(t)::int as bin from ranked where p = 1""")
def trend_scanning(spark, sf_dir):
    return labeling.trend_scanning(tick_bars_of(spark, sf_dir).select("symbol", "ts", "seq", "close"), 10, 5, 1)


@query()
def matrix_flags(spark, sf_dir):
    return labeling.matrix_flag(tick_bars_of(spark, sf_dir).select("symbol", "ts", "seq", "close"), 20, "leigh_bull")


# Features --------------------------------------------------------------------------------------------

H, L, C, O = "high", "low", "close", "open"  # noqa: E741


@query(f"""with {BARS}, p as (select * from b where low > 0),
x as (select *, pow(ln(high / low), 2) as r, pow(ln(close / open), 2) as m, ln(open / lag(close) {W}) as n, ln(close / lag(open) {W}) as d,
  ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) as i from p),
y as (select *, r / (4 * ln(2)) as p1, r / 2 - (2 * ln(2) - 1) * m as p2, n * n as nn, d * d as dd from x)
select symbol, ts, seq, sqrt({full('avg', 'p1', 10)}) as parkinson, sqrt({full('avg', 'p2', 10)}) as garman_klass,
  sqrt({full('sum', 'nn', 10)} / 9 + (0.34 / (1.34 + 11.0 / 9.0)) * {full('sum', 'dd', 10)} / 9 + (1 - 0.34 / (1.34 + 11.0 / 9.0)) * {full('sum', 'i', 10)} / 9) as yang_zhang from y""")
def range_volatility(spark, sf_dir):
    b = tick_bars_of(spark, sf_dir).where("low > 0")
    return b.select("symbol", "ts", "seq", features.parkinson_vol(window=10).alias("parkinson"), features.garman_klass_vol(window=10).alias("garman_klass"), features.yang_zhang_vol(window=10).alias("yang_zhang"))


@query(f"""with {BARS}, x as (select *, close - lag(close) {W} as d from b), y as (select *, lag(d) {W} as p from x),
z as (select *, 2 * sqrt(abs(case when count(d + p) {last_n(20)} >= 20 then covar_samp(d, p) {last_n(20)} end)) as roll_measure from y)
select symbol, ts, seq, roll_measure, case when dollar <> 0 then roll_measure / dollar end as roll_impact from z""")
def roll_measures(spark, sf_dir):
    return features.with_roll(tick_bars_of(spark, sf_dir)).select("symbol", "ts", "seq", "roll_measure", "roll_impact")


TWO = last_n(2)


@query(f"""with {BARS}, p as (select * from b where low > 0), x as (select *, pow(ln(high / low), 2) as r from p),
y as (select *, case when count(r) {TWO} = 2 then sum(r) {TWO} end as two, case when count(r) {TWO} = 2 then pow(ln(max(high) {TWO} / min(low) {TWO}), 2) end as g from x),
z as (select *, {full('avg', 'two', 20)} as be from y),
a as (select *, greatest((sqrt(2) - 1) * sqrt(be) / (3 - 2 * sqrt(2)) - sqrt(g / (3 - 2 * sqrt(2))), 0) as al,
  greatest((1 / sqrt(2) - 1) * sqrt(be) / (sqrt(8 / pi()) * (3 - 2 * sqrt(2))) + sqrt(g / (8 / pi() * (3 - 2 * sqrt(2)))), 0) as si from z)
select symbol, ts, seq, case when be is not null then 2 * (exp(al) - 1) / (1 + exp(al)) end as corwin_schultz, case when be is not null then si end as bekker_parkinson from a""")
def corwin_schultz(spark, sf_dir):
    return features.with_corwin_schultz(tick_bars_of(spark, sf_dir).where("low > 0")).select("symbol", "ts", "seq", "corwin_schultz", "bekker_parkinson")


@query(f"""with {BARS}, p as (select * from b where close > 0), x as (select *, close - lag(close) {W} as d, ln(close / lag(close) {W}) as r from p),
y as (select *, last_value(case when d <> 0 then sign(d)::double end ignore nulls) {last_n(1000000)} as sd, last_value(case when r <> 0 then sign(r)::double end ignore nulls) {last_n(1000000)} as sr from x),
z as (select *, case when volume * sd <> 0 then d / (volume * sd) end as k, case when dollar <> 0 then abs(r) / dollar end as a, case when sr * sqrt(dollar) <> 0 then r / (sr * sqrt(dollar)) end as h from y)
select symbol, ts, seq, {full('avg', 'k', 20)} as kyle_lambda, {full('avg', 'a', 20)} as amihud_lambda, {full('avg', 'h', 20)} as hasbrouck_lambda from z""")
def bar_lambdas(spark, sf_dir):
    return features.with_lambdas(tick_bars_of(spark, sf_dir).where("close > 0")).select("symbol", "ts", "seq", "kyle_lambda", "amihud_lambda", "hasbrouck_lambda")


@query(f"""with {BARS}, x as (select *, abs(2 * cum_buy_volume - volume) as g from b)
select symbol, ts, seq, case when volume <> 0 then {full('avg', 'g', 5)} / volume end as vpin from x""")
def vpin(spark, sf_dir):
    return features.with_vpin(tick_bars_of(spark, sf_dir), 5).select("symbol", "ts", "seq", "vpin")


@query(f"""with {BARS}, x as (select *, close - lag(close) {W} as d from b), z as (select *, d / nullif({full('stddev_samp', 'd', 20)}, 0) as z from x)
select symbol, ts, seq, volume * {normal_cdf_sql('z')} as bvc_buy_volume from z""")
def bulk_volume(spark, sf_dir):
    return features.with_bulk_volume(tick_bars_of(spark, sf_dir)).select("symbol", "ts", "seq", "bvc_buy_volume")


@query(f"""with {SIGNED}, q as (select * from signed where price > 0),
m as (select *, price - lag(price) over (partition by symbol order by ts, seq) as pd, abs(ln(price / lag(price) over (partition by symbol order by ts, seq))) as pr, price * volume as dl from q),
x as (select *, volume * sgn as x1, dl as x2, sqrt(dl) * sgn as x3 from m where pd is not null),
s as (select symbol, count(*) as n, sum(x1 * x1) as a1, sum(x1 * pd) as b1, sum(pd * pd) as c1, sum(x2 * x2) as a2, sum(x2 * pr) as b2, sum(pr * pr) as c2, sum(x3 * x3) as a3, sum(x3 * pr) as b3 from x group by symbol)
select symbol, b1 / a1 as kyle_lambda, b1 / a1 / sqrt((c1 - b1 / a1 * b1) / ((n - 1) * a1)) as kyle_t, b2 / a2 as amihud_lambda, b2 / a2 / sqrt((c2 - b2 / a2 * b2) / ((n - 1) * a2)) as amihud_t,
  b3 / a3 as hasbrouck_lambda, b3 / a3 / sqrt((c2 - b3 / a3 * b3) / ((n - 1) * a3)) as hasbrouck_t from s""")
def trade_lambdas(spark, sf_dir):
    t = bars.signed(event_ticks(spark, sf_dir)).where("price > 0")
    return features.trade_lambdas(t, ["symbol"])


@query(f"""with {EVENT_TICKS} select symbol, sum(price * volume) / sum(volume) as vwap, avg(volume) as avg_tick_size from ticks group by symbol""")
def vwap(spark, sf_dir):
    return features.vwap(event_ticks(spark, sf_dir), ["symbol"])


_FFD = features.ffd_weights(0.5, 0.01)


@query(f"""with {BARS}, x as (select symbol, ts, seq, list(close) {last_n(len(_FFD))} as y from b)
select symbol, ts, seq, case when len(y) = {len(_FFD)} then list_dot_product(y::double[], {_FFD[::-1]}::double[]) end as frac_diff from x""")
def frac_diff_ffd(spark, sf_dir):
    return features.frac_diff_ffd(tick_bars_of(spark, sf_dir), 0.5, 0.01).select("symbol", "ts", "seq", "frac_diff")


@query(f"""with recursive {BARS}, x as (select symbol, ts, seq, close, row_number() {W} - 1 as t, count(*) over (partition by symbol) as n from b),
w(k, v) as (select 0::bigint, 1.0::double union all select k + 1, -v * (0.5 - (k + 1) + 1) / (k + 1) from w where k + 1 < (select max(n) from x)),
tails as (select s.symbol, w.k, sum(abs(v)) over (partition by s.symbol order by w.k desc) / sum(abs(v)) over (partition by s.symbol) as share from (select distinct symbol, n from x) s join w on w.k < s.n),
skips as (select symbol, count(*) filter (share > 0.05) as skip from tails group by symbol),
y as (select x.symbol, x.ts, x.seq, x.t, sum(w.v * p.close) as y from x join x p on p.symbol = x.symbol and p.t <= x.t join w on w.k = x.t - p.t group by all)
select y.symbol, y.ts, y.seq, case when y.t >= skip then y.y end as frac_diff from y join skips using (symbol)""")
def frac_diff(spark, sf_dir):
    return features.frac_diff(tick_bars_of(spark, sf_dir), 0.5, 0.05).select("symbol", "ts", "seq", "frac_diff")


@query(f"""with {BARS}, c as (select * from b where close > 0),
r as (select c.symbol, c.ts, c.seq, c.close / (select p.close from c p where p.symbol = c.symbol and p.ts < c.ts - interval 1 day order by p.ts desc, p.seq desc limit 1) - 1 as x from c),
k as (select *, row_number() over (partition by symbol order by ts, seq) as k from r where x is not null),
j as (select t.symbol, t.ts, t.seq, t.x as own, p.x, pow(1 - 2.0 / 51, t.k - p.k) as w from k t join k p on p.symbol = t.symbol and p.k <= t.k),
m as (select *, sum(w * x) over g / sum(w) over g as m from j window g as (partition by symbol, ts, seq)),
v as (select symbol, ts, seq, max(own) as own, count(*) as n, sum(w * (x - m) * (x - m)) / sum(w) as v, sum(w) as sw, sum(w * w) as sq from m group by all)
select symbol, ts, seq, own as daily_return, case when n > 1 then sqrt(v * sw * sw / (sw * sw - sq)) end as daily_vol from v""")
def daily_vol(spark, sf_dir):
    return features.daily_vol(tick_bars_of(spark, sf_dir).where("close > 0"), 50)


@query(f"""with {BARS}, nmsg as (select symbol, bar_id // 10 as g, sgn from numbered),
c as (select symbol, g, sgn, count(*) as k from nmsg group by all), s as (select *, sum(k) over (partition by symbol, g) as n from c)
select symbol, g as block, abs(sum(k / n * log2(k / n))) as shannon from s group by symbol, g""")
def shannon_entropy(spark, sf_dir):
    t = bars.signed(event_ticks(spark, sf_dir)).withColumn("_n", F.row_number().over(ordered()) - 1)
    t = t.withColumn("block", F.floor(F.col("_n") / (10 * TICKS)))
    m = t.groupBy("symbol", "block").agg(entropy.encode_signs(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "sign"))), lambda x: x["sign"])).alias("message"))
    m = m.withColumn("key", F.struct("symbol", "block"))
    return entropy.shannon_sql(m, "key", "message").select("key.symbol", "key.block", "shannon")


@query()
def message_entropies(spark, sf_dir):
    t = bars.signed(event_ticks(spark, sf_dir)).withColumn("_n", F.row_number().over(ordered()) - 1)
    t = t.withColumn("block", F.floor(F.col("_n") / (10 * TICKS)))
    m = t.groupBy("symbol", "block").agg(entropy.encode_signs(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "sign"))), lambda x: x["sign"])).alias("message"))
    return entropy.entropies(m, "message").drop("message")


# Dependence, breaks ----------------------------------------------------------------------------------

RET = f"""{PANEL}, ret as (select ts, asset, price / lag(price) over (partition by asset order by ts) - 1 as value from panel),
pr as (select a.ts, a.asset as a, b.asset as b, a.value as x, b.value as y from ret a join ret b on a.ts = b.ts and a.asset < b.asset where a.value is not null and b.value is not null)"""


def rets(spark, sf_dir):
    return portfolio.returns(panel(spark, sf_dir)).withColumnRenamed("ret", "value")


@query(f"""with {RET}, r as (select a, b, corr(x, y) as rho from pr group by a, b)
select a, b, rho, sqrt((1 - rho) / 2) as angular, sqrt((1 - abs(rho)) / 2) as absolute_angular, sqrt((1 - rho * rho) / 2) as squared_angular from r""")
def correlation_distances(spark, sf_dir):
    return codependence.correlation_distances(rets(spark, sf_dir))


@query(f"""with {RET}, k as (select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2 as rx,
  rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2 as ry from pr)
select a, b, corr(rx, ry) as spearman from k group by a, b""")
def spearman(spark, sf_dir):
    return codependence.spearman(rets(spark, sf_dir))


@query(f"""with {RET}, m as (select *, min(x) over (partition by a, b) as lx, max(x) over (partition by a, b) as hx, min(y) over (partition by a, b) as ly, max(y) over (partition by a, b) as hy from pr),
c as (select a, b, least(7, floor((x - lx) * 8 / (hx - lx)))::int as i, least(7, floor((y - ly) * 8 / (hy - ly)))::int as j, count(*) as n from m group by all),
p as (select *, n / sum(n) over (partition by a, b) as p, sum(n) over (partition by a, b, i) / sum(n) over (partition by a, b) as pi, sum(n) over (partition by a, b, j) / sum(n) over (partition by a, b) as pj from c),
h as (select a, b, sum(-p * ln(pi)) as hx, sum(-p * ln(pj)) as hy, sum(-p * ln(p)) as hxy from p group by a, b), mi as (select *, greatest(0, hx + hy - hxy) as mi from h)
select a, b, mi as mutual_info, mi / least(hx, hy) as mutual_info_norm, hx + hy - 2 * mi as variation, (hx + hy - 2 * mi) / (hx + hy - mi) as variation_norm from mi""")
def information(spark, sf_dir):
    return codependence.information(rets(spark, sf_dir), 8)


@query(f"""with {RET}, d as (select l.a, l.b, l.ts as i, abs(l.x - r.x) as dx, abs(l.y - r.y) as dy, r.ts as j from pr l join pr r on l.a = r.a and l.b = r.b),
m as (select *, dx - avg(dx) over (partition by a, b, i) - avg(dx) over (partition by a, b, j) + avg(dx) over (partition by a, b) as u,
  dy - avg(dy) over (partition by a, b, i) - avg(dy) over (partition by a, b, j) + avg(dy) over (partition by a, b) as v from d)
select a, b, sqrt(greatest(0, sum(u * v))) / pow(sum(u * u) * sum(v * v), 0.25) as distance_correlation from m group by a, b""")
def distance_correlation(spark, sf_dir):
    return codependence.distance_correlations(rets(spark, sf_dir))


@query(f"""with {RET}, k as (select *, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2 as rx,
  rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2 as ry from pr),
g as (select a, b, corr(rx, ry) as rho, avg(x) as mx, avg(y) as my, stddev_pop(x) as sx, stddev_pop(y) as sy, least(min(x), min(y)) as low, count(*) as n,
  3 * sum((x - y) * (x - y)) / (count(*) * (count(*) * count(*) - 1)) as d1 from k group by a, b),
hx as (select pr.a, pr.b, floor((x - low) / 0.05) as c, count(*) / max(n) as px from pr join g on g.a = pr.a and g.b = pr.b group by all),
hy as (select pr.a, pr.b, floor((y - low) / 0.05) as c, count(*) / max(n) as py from pr join g on g.a = pr.a and g.b = pr.b group by all),
h as (select coalesce(hx.a, hy.a) as a, coalesce(hx.b, hy.b) as b, sum(pow(sqrt(coalesce(px, 0)) - sqrt(coalesce(py, 0)), 2)) / 2 as d0
  from hx full join hy on hx.a = hy.a and hx.b = hy.b and hx.c = hy.c group by all)
select g.a, g.b, sqrt(greatest(0, 0.5 * (1 - rho) / 2 + 0.5 * (1 - sqrt(2 * sx * sy / (sx * sx + sy * sy)) * exp(-(mx - my) * (mx - my) / (sx * sx + sy * sy) / 4)))) as gpr,
  sqrt(greatest(0, 0.5 * d1 + 0.5 * d0)) as gnpr
from g join h on g.a = h.a and g.b = h.b""")
def gpr_distances(spark, sf_dir):
    r = rets(spark, sf_dir)
    return codependence.gpr_distance(r, 0.5).join(codependence.gnpr_distance(r, 0.5, 0.05), ["a", "b"])


@query(f"""with {RET}, k as (select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2 as rx,
  rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2 as ry from pr),
c as (select a, b, corr(rx, ry) as v from k group by a, b), full_c as (select a, b, v from c union all select b, a, v from c union all select asset, asset, 1.0 from (select distinct asset from ret))
select a as i, b as j, sqrt((1 - round(v, 5)) / 2) as value from full_c""")
def dependence_distances(spark, sf_dir):
    return codependence.distance_matrix(codependence.dependence_matrix(rets(spark, sf_dir), "spearmans_rho"))


@query(f"""with {BARS}, x as (select symbol, ts, seq, lag(close) {W} as x, close - lag(close) {W} as d from b), y as (select * from x where x is not null),
z as (select *, sum(x * x) over v as xx, sum(x * d) over v as xy, sum(d * d) over (partition by symbol) as yy, count(*) over (partition by symbol) as n, row_number() {W} as k
  from y window v as (partition by symbol order by ts, seq rows between 1 following and unbounded following))
select symbol, ts, seq, (xy / xx) / sqrt(greatest(yy - xy / xx * xy, 0) / (n - 1) / xx) as dfc from z where k >= 20 and k <= n - 20""")
def chow_type(spark, sf_dir):
    return breaks.chow_type(tick_bars_of(spark, sf_dir))


@query(f"""with {BARS}, x as (select symbol, ts, seq, close as y, row_number() {W} as k, close - lag(close) {W} as d from b),
s as (select *, sum(d * d) {last_n(1000000)} as ss from x),
p as (select t.symbol, t.ts, t.seq, (t.y - n.y) / sqrt(t.k - n.k) / (t.ss / (t.k - 1)) as stat, sqrt(4.6 + ln(t.k - n.k)) as critical, n.k as nk
  from s t join s n on n.symbol = t.symbol and n.k < t.k where t.ss > 0),
r as (select *, row_number() over (partition by symbol, ts, seq order by stat desc, nk) as q from p)
select symbol, ts, seq, stat, critical from r where q = 1""")
def chu_stinchcombe_white(spark, sf_dir):
    return breaks.csw(tick_bars_of(spark, sf_dir))


@query()
def sadf(spark, sf_dir):
    weekly = panel(spark, sf_dir).select(F.col("asset").alias("symbol"), "ts", F.lit(0).cast("long").alias("seq"), F.log("price").alias("close"))
    return breaks.sadf(weekly, "linear", 1, 12)


# Samples ---------------------------------------------------------------------------------------------


def intervals(spark, sf_dir):
    e, close = barrier_events(spark, sf_dir)
    return e.select("symbol", F.col("event_id").alias("label_id"), "t0", "t1").localCheckpoint(), close


CONC = f"""{EVENTS}, conc as (select c.symbol, c.ts, c.close, c.seq, (select count(*) from ev where ev.symbol = c.symbol and c.ts between ev.t0 and ev.t1) as n from c)"""


@query(f"with {CONC} select distinct symbol, ts, n from conc")
def concurrency(spark, sf_dir):
    labels, close = intervals(spark, sf_dir)
    return sampling.concurrency(close, labels)


@query(f"""with {CONC}, rw as (select distinct symbol, ts, n from conc where n > 0)
select ev.symbol, ev.event_id as label_id, avg(1.0 / rw.n) as uniqueness from ev join rw on rw.symbol = ev.symbol and rw.ts between ev.t0 and ev.t1 group by all""")
def average_uniqueness(spark, sf_dir):
    labels, close = intervals(spark, sf_dir)
    return sampling.average_uniqueness(close, labels)


@query(f"""with {CONC}, lr as (select symbol, ts, n, ln(close / lag(close) {W}) as r from conc),
s as (select ev.symbol, ev.event_id as label_id, abs(sum(case when lr.n > 0 then coalesce(lr.r, 0) / lr.n else 0 end)) as x from ev join lr on lr.symbol = ev.symbol and lr.ts between ev.t0 and ev.t1 group by all)
select symbol, label_id, x * count(*) over (partition by symbol) / sum(x) over (partition by symbol) as weight from s""")
def weights_by_return(spark, sf_dir):
    labels, close = intervals(spark, sf_dir)
    return sampling.weights_by_return(close, labels)


@query(f"""with {CONC}, rw as (select distinct symbol, ts, n from conc where n > 0),
u as (select ev.symbol, ev.event_id as label_id, avg(1.0 / rw.n) as u from ev join rw on rw.symbol = ev.symbol and rw.ts between ev.t0 and ev.t1 group by all),
q as (select *, sum(u) over (partition by symbol order by label_id rows between unbounded preceding and current row) as s, sum(u) over (partition by symbol) as t from u)
select symbol, label_id, greatest(0, 1 - (0.5 / t) * t + (0.5 / t) * s) as weight from q""")
def weights_by_time_decay(spark, sf_dir):
    labels, close = intervals(spark, sf_dir)
    u = sampling.average_uniqueness(close, labels)
    return sampling.weights_by_time_decay(u, "label_id", 0.5).select("symbol", "label_id", "weight")


@query()
def sequential_bootstrap(spark, sf_dir):
    labels, close = intervals(spark, sf_dir)
    return sampling.bootstrap_by_symbol(labels, close)


def info_rows(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("t0")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("t0")  # one row a day
    return o.select((F.row_number().over(w) - 1).cast("long").alias("row_id"), "t0", (F.col("t0") + F.expr("interval 3 days")).alias("t1"))


INFO = "info as (select row_number() over (order by t0) - 1 as row_id, t0, t0 + interval 3 day as t1 from (select distinct o_orderdate::timestamp as t0 from orders))"


@query(f"""with {INFO}, n as (select count(*) as n from info), f as (select unnest(range(5)) as k),
bd as (select k, k * (n // 5) + least(k, n % 5) as a, (k + 1) * (n // 5) + least(k + 1, n % 5) as z, n from f, n),
iv as (select k, a, z, (select t1 from info where row_id = a) as lo, (select t1 from info where row_id = least(n - 1, z - 1 + case when z < n then (n * 0.01)::int else 0 end)) as hi from bd)
select k::int as split, row_id, case when row_id between a and z - 1 then 'test' else 'train' end as part from iv, info
where row_id between a and z - 1 or not (t0 <= hi and t1 >= lo)""".replace("(n * 0.01)::int", "floor(n * 0.01)::bigint"))
def purged_folds(spark, sf_dir):
    return sampling.purged_folds(info_rows(spark, sf_dir), 5, 1, 0.01)


@query(f"""with {INFO}, n as (select count(*) as n from info), f as (select unnest(range(5)) as k),
bd as (select k, k * (n // 5) + least(k, n % 5) as a, (k + 1) * (n // 5) + least(k + 1, n % 5) as z, n from f, n),
iv as (select k, a, z, (select t1 from info where row_id = a) as lo, (select t1 from info where row_id = least(n - 1, z - 1 + case when z < n then floor(n * 0.01)::bigint else 0 end)) as hi from bd),
pr as (select row_number() over (order by x.k, y.k) - 1 as split, x.a as a1, x.z as z1, x.lo as lo1, x.hi as hi1, y.a as a2, y.z as z2, y.lo as lo2, y.hi as hi2 from iv x join iv y on x.k < y.k),
m as (select split, case when row_id between a1 and z1 - 1 or row_id between a2 and z2 - 1 then 'test' when not (t0 <= hi1 and t1 >= lo1) and not (t0 <= hi2 and t1 >= lo2) then 'train' end as part from pr, info)
select split::int as split, part, count(*) as count from m where part is not null group by split, part""")
def combinatorial_folds(spark, sf_dir):
    return sampling.purged_folds(info_rows(spark, sf_dir), 5, 2, 0.01).groupBy("split", "part").count()


# Bets ------------------------------------------------------------------------------------------------


def bets(spark, sf_dir):
    b = tick_bars_of(spark, sf_dir)
    return b.select(F.col("ts").alias("t0"), (F.col("ts") + F.expr("interval 1 day")).alias("t1"), ((F.col("seq") * 37) % 100 / 100.0).alias("prob"), F.when(F.col("seq") % 3 == 0, -1.0).otherwise(1.0).alias("side"))


BETS = f"{BARS}, bets as (select ts as t0, ts + interval 1 day as t1, ((seq * 37) % 100) / 100.0::double as prob, case when seq % 3 = 0 then -1.0 else 1.0 end::double as side from b)"


@query(f"""with {BETS}, z as (select *, case when prob * (1 - prob) > 0 then (prob - 0.5) / sqrt(prob * (1 - prob)) end as z from bets),
g as (select t0, side * case when prob >= 1 then 1.0 when prob <= 0 then -1.0 else 2 * {normal_cdf_sql('z')} - 1 end as x from z)
select t0, greatest(-1.0, least(1.0, round_even(x / 0.1, 0) * 0.1 + 0.0)) as size from g""")
def probability_bets(spark, sf_dir):
    return bet_sizing.probability_sizes(bets(spark, sf_dir), 2, 0.1)


@query(f"""with {BETS}, tm as (select t0 as ts from bets union select t1 from bets)
select tm.ts, coalesce((select avg(prob) from bets where bets.t0 <= tm.ts and tm.ts < bets.t1), 0) as signal from tm""")
def average_active_signals(spark, sf_dir):
    return bet_sizing.average_active(bets(spark, sf_dir).withColumnRenamed("prob", "signal"))


@query(f"""with {BETS}, st as (select distinct t0 from bets),
c as (select st.t0, (select count(*) from bets where side > 0 and bets.t0 <= st.t0 and st.t0 < bets.t1) as active_long, (select count(*) from bets where side < 0 and bets.t0 <= st.t0 and st.t0 < bets.t1) as active_short from st)
select t0, active_long, active_short, active_long / max(active_long) over () - active_short / max(active_short) over () as bet_size from c""")
def budget_bets(spark, sf_dir):
    return bet_sizing.budget_sizes(bets(spark, sf_dir))


_WS = bet_sizing.width(10, 0.95, "sigmoid")


@query(f"""with {BARS}, d as (select symbol, seq, close as forecast, open as market, seq % 7 - 3 as position, 20 as max_position from b),
s as (select *, (forecast - market) / sqrt({_WS} + (forecast - market) * (forecast - market)) as bet_size from d),
t as (select *, trunc(bet_size * max_position)::bigint as target_position from s),
r as (select *, abs(position + case when target_position >= position then 1 else -1 end) as f, abs(target_position + 1) as l from t)
select symbol, seq, bet_size, target_position,
  case when target_position <> position and l > f then list_sum(list_transform(range(f, l), lambda j: forecast - j / 20.0 * sqrt({_WS} / (1 - (j / 20.0) * (j / 20.0))))) / (l - f) end as limit_price from r""")
def dynamic_bets(spark, sf_dir):
    d = tick_bars_of(spark, sf_dir).select("symbol", "seq", F.col("close").alias("forecast"), F.col("open").alias("market"), (F.col("seq") % 7 - 3).alias("position"), F.lit(20).alias("max_position"))
    return bet_sizing.dynamic_sizes(d).select("symbol", "seq", "bet_size", "target_position", "limit_price")


@query()
def reserve_bets(spark, sf_dir):
    return bet_sizing.reserve_sizes(bets(spark, sf_dir), runs=4, epsilon=0.02, variant=1, max_iter=200)


# Back-tests ------------------------------------------------------------------------------------------


def held(spark, sf_dir):
    p = panel(spark, sf_dir)
    w = Window.partitionBy("asset").orderBy("ts")
    r = F.col("price") / F.lag("price").over(w) - 1
    return p.select(F.col("asset").alias("symbol"), "ts", "price", r.alias("ret"), F.when(F.abs(r) > 0.02, F.signum(r)).otherwise(0.0).alias("position"))


HELD = f"""{PANEL}, hr as (select asset as symbol, ts, price, price / lag(price) over (partition by asset order by ts) - 1 as ret from panel),
held as (select *, case when abs(ret) > 0.02 then sign(ret)::double else 0.0 end as position from hr)"""


@query(f"""with {HELD}, x as (select *, lag(position) over v as b, lead(position) over v as n from held window v as (partition by symbol order by ts))
select symbol, ts from x where position * b < 0 or (position = 0 and b <> 0) or (n is null and position <> 0)""")
def flips_and_flattenings(spark, sf_dir):
    return backtest.flips_and_flattenings(held(spark, sf_dir))


@query(f"""with {HELD}, closed as (select symbol, ts, case when lead(ts) over (partition by symbol order by ts) is null then 0.0 else position end as position from held),
k as (select symbol, ts, position, row_number() over v as i, lag(position) over v as before, lead(ts) over v as nxt from closed window v as (partition by symbol order by ts)),
g as (select *, sum(case when i = 1 or position is distinct from before then 1 else 0 end) over (partition by symbol order by ts) as island from k),
spans as (select symbol, island, min(ts) as a, any_value(position) as position from g group by all),
ends as (select *, lead(a) over (partition by symbol order by a) as z from spans),
last as (select symbol, max(position) filter (nxt is null) as final, max(ts) as t from k group by symbol)
select e.symbol, case when max(l.final) = 0 then avg(case when e.position <> 0 then (epoch(z) - epoch(a)) / 86400.0 end) end as days
from ends e join last l using (symbol) group by e.symbol""")
def holding_periods(spark, sf_dir):
    # All positions are closed on their last date.
    last = F.lead("ts").over(Window.partitionBy("symbol").orderBy("ts")).isNull()
    return backtest.average_holding_period(held(spark, sf_dir).withColumn("position", F.when(last, 0.0).otherwise(F.col("position"))))


@query(f"""with {HELD}, t as (select *, max(price) over (partition by symbol order by ts rows between unbounded preceding and current row) as top from held),
g as (select symbol, top, min(price) as low, min(ts) as ts from t group by symbol, top having min(price) < top)
select symbol, ts, 1 - low / top as drawdown, (epoch_us(lead(ts) over (partition by symbol order by ts)) - epoch_us(ts)) / (86400000000 * 365.25) as years_under_water from g""")
def drawdowns(spark, sf_dir):
    return backtest.drawdowns(held(spark, sf_dir), column="price")


@query(f"""with {HELD} select symbol, count(ret) as n, avg(ret) / stddev_samp(ret) * sqrt(52) as sharpe, (avg(ret) - 0.001) / stddev_samp(ret) * sqrt(52) as information,
  (avg(pow(ret, 3)) - 3 * avg(ret) * avg(ret * ret) + 2 * pow(avg(ret), 3)) / pow(stddev_pop(ret), 3) as skewness, kurtosis_pop(ret) + 3 as kurtosis from held group by symbol""")
def return_ratios(spark, sf_dir):
    return backtest.ratios(held(spark, sf_dir), 52, 0.0, 0.001)


@query(f"""with {HELD}, r as (select * from held where ret is not null),
s as (select symbol, sum(ret) as ta, sum(ret * ret) as qa, count(*) as na, sum(case when ret >= 0 then ret end) as tp, sum(case when ret >= 0 then ret * ret end) as qp, count(case when ret >= 0 then 1 end) as np,
  sum(case when ret < 0 then ret end) as tm, sum(case when ret < 0 then ret * ret end) as qm, count(case when ret < 0 then 1 end) as nm from r group by symbol),
c as (select symbol, date_trunc('month', ts) as u, count(*) as n from r group by all),
g as (select symbol, sum(n) as t, sum(n * n) as q, date_diff('month', min(u), max(u)) + 1 as k from c group by symbol)
select s.symbol, case when na > 2 then (qa / (ta * ta) - 1 / na) / (1 - 1 / na) end as all_bets, case when np > 2 then (qp / (tp * tp) - 1 / np) / (1 - 1 / np) end as positive,
  case when nm > 2 then (qm / (tm * tm) - 1 / nm) / (1 - 1 / nm) end as negative, case when k > 2 then (q / (t * t) - 1 / k) / (1 - 1 / k) end as in_time from s join g using (symbol)""")
def bets_concentration(spark, sf_dir):
    return backtest.bets_concentration(held(spark, sf_dir).where("ret is not null"))


@query()
def sharpe_haircuts(spark, sf_dir):
    r = backtest.ratios(held(spark, sf_dir), 52).agg(F.max("sharpe").alias("s"), F.max("n").alias("n")).first()
    cuts = backtest.haircut("W", r["n"], r["s"], True, True, 0.0, 10, 0.2, simulations=2000)
    return spark.createDataFrame([(k, *map(float, v)) for k, v in cuts.items()], "method string, p double, sharpe double, haircut double")


# Portfolios ------------------------------------------------------------------------------------------


@query(f"""with {RET}, r2 as (select * from ret where value is not null)
select a.asset as i, b.asset as j, covar_pop(a.value, b.value) as value from r2 a join r2 b on a.ts = b.ts and a.asset <= b.asset group by all""")
def covariance(spark, sf_dir):
    return portfolio.covariance(portfolio.returns(panel(spark, sf_dir)))


@query(f"""with {RET}, r2 as (select ts, asset, value, row_number() over (partition by asset order by ts desc) - 1 as age from ret where value is not null)
select asset, sum(value * pow(1 - 2.0 / 501, age)) / sum(pow(1 - 2.0 / 501, age)) * 52 as ewm_return, avg(value) * 52 as mean_return from r2 group by asset""")
def expected_returns(spark, sf_dir):
    r = portfolio.returns(panel(spark, sf_dir))
    return portfolio.ewm_returns(r, 52).withColumnRenamed("mean_return", "ewm_return").join(portfolio.mean_returns(r, 52), "asset")


@query(f"""with {RET}, r2 as (select ts, asset, least(value, 0) as v from ret where value is not null), k as (select count(distinct asset) as k from r2)
select a.asset as i, b.asset as j, sum(a.v * b.v) / (count(*) * max(k.k)) as value from r2 a join r2 b on a.ts = b.ts and a.asset <= b.asset, k group by all""")
def semi_covariance(spark, sf_dir):
    return portfolio.covariance(portfolio.returns(panel(spark, sf_dir)), "semi")


@query(f"""with {RET}, r2 as (select * from ret where value is not null),
p as (select a.ts, a.asset as i, b.asset as j, a.value as x, b.value as y from r2 a join r2 b on a.ts = b.ts and a.asset <= b.asset),
q as (select i, j, (x - avg(x) over (partition by i, j)) * (y - avg(y) over (partition by i, j)) as p, pow(1 - 2.0 / 61, row_number() over (partition by i, j order by ts desc) - 1) as w from p)
select i, j, sum(p * w) / sum(w) as value from q group by i, j""")
def exponential_covariance(spark, sf_dir):
    return portfolio.covariance(portfolio.returns(panel(spark, sf_dir)), "exponential")


@query(f"""with {RET}, r2 as (select ts, asset, value as r, row_number() over (partition by asset order by value) as k, count(*) over (partition by asset) as n,
  max(value) over (partition by asset order by ts) - value as fall from ret where value is not null),
m as (select *, max(fall) over (partition by asset order by ts) as most from r2),
o as (select *, row_number() over (partition by asset order by most) as q from m),
v as (select *, max(case when k = ceil(0.05 * (n - 1) - 1e-9) + 1 then r end) over (partition by asset) as v, max(case when q = ceil(0.95 * (n - 1) - 1e-9) + 1 then most end) over (partition by asset) as c from o)
select asset, max(v) as var, avg(case when r < v then r end) as shortfall, avg(case when most >= c then most end) as cdar from v group by asset""")
def portfolio_risk(spark, sf_dir):
    return portfolio.risk_metrics(portfolio.returns(panel(spark, sf_dir)))


@query(f"""with {RET}, v as (select asset, 1 / var_pop(value) as w from ret group by asset) select asset, w / sum(w) over () as weight from v""")
def inverse_variance_weights(spark, sf_dir):
    names, cov = portfolio.to_matrix(portfolio.covariance(portfolio.returns(panel(spark, sf_dir))))
    return portfolio.weights_table(spark, names, portfolio.inverse_variance(cov))


@query()
def hierarchical_weights(spark, sf_dir):
    names, cov = portfolio.to_matrix(portfolio.covariance(portfolio.returns(panel(spark, sf_dir))))
    out = portfolio.weights_table(spark, names, portfolio.hierarchical_risk_parity(cov)).withColumn("method", F.lit("hrp"))
    for risk in ("equal_weighting", "variance", "standard_deviation"):
        out = out.unionByName(portfolio.weights_table(spark, names, portfolio.hierarchical_equal_risk(cov, 3, risk)).withColumn("method", F.lit(f"herc_{risk}")))
    return out


@query()
def mean_variance_weights(spark, sf_dir):
    r = portfolio.returns(panel(spark, sf_dir))
    names, cov = portfolio.to_matrix(portfolio.covariance(r))
    means = {x["asset"]: x["mean_return"] for x in portfolio.mean_returns(r, 1).collect()}
    import numpy as np

    mu, out = np.array([means[n] for n in names]), None
    for s in ("inverse_variance", "min_volatility", "max_return_min_volatility", "max_sharpe", "efficient_risk", "efficient_return", "max_diversification", "max_decorrelation"):
        w = portfolio.mean_variance(s, cov, mu, target_return=float(mu.mean()), target_risk=float(np.diag(cov).mean()))
        t = portfolio.weights_table(spark, names, w).withColumn("method", F.lit(s))
        out = t if out is None else out.unionByName(t)
    points = portfolio.critical_line(mu, cov)
    for s in ("max_sharpe", "min_volatility"):
        out = out.unionByName(portfolio.weights_table(spark, names, portfolio.critical_line_best(points, mu, cov, s)).withColumn("method", F.lit(f"cla_{s}")))
    return out.unionByName(portfolio.weights_table(spark, names, portfolio.nested_clusters(cov)).withColumn("method", F.lit("nco")))


@query()
def online_selection(spark, sf_dir):
    return online.select(panel(spark, sf_dir), list(online.STRATEGIES)).groupBy("strategy").agg(F.max_by("wealth", "ts").alias("wealth"), F.countDistinct("ts").alias("dates"))


# Several instruments, features of bars, clusters and importance --------------------------------------


@query()
def bar_features(spark, sf_dir):
    t = bars.signed(event_ticks(spark, sf_dir)).where("price > 0").withColumn("tick_num", F.row_number().over(ordered()).cast("long"))
    ends = t.where(F.col("tick_num") % 20 == 0).select("symbol", "tick_num", (F.col("tick_num") / 20).cast("long").alias("bar_id"))
    return features.bar_features(t, ends, {float(k): chr(97 + k // 10) for k in range(0, 100, 10)})


@query()
def least_difference(spark, sf_dir):
    return features.least_difference(tick_bars_of(spark, sf_dir))


def contracts(spark, sf_dir):
    """Each priority as a contract in force for a quarter in turn; its open is the mean of the week's lower half of values."""
    p = panel(spark, sf_dir)
    turn = F.pmod(F.year("ts") * 4 + F.quarter("ts"), F.lit(3))
    current = F.when(turn == 0, "1-URGENT").when(turn == 1, "2-HIGH").otherwise("5-LOW")
    return p.select("ts", F.col("asset").alias("security"), current.alias("current_security"), (F.col("price") * 0.99).alias("open"), F.col("price").alias("close"))


@query(f"""with {PANEL}, c as (select ts, asset as security, case when (year(ts) * 4 + quarter(ts)) % 3 = 0 then '1-URGENT' when (year(ts) * 4 + quarter(ts)) % 3 = 1 then '2-HIGH' else '5-LOW' end as cur, price * 0.99 as open, price as close from panel),
d as (select *, lag(close) over (order by ts) as before, row_number() over (partition by security order by ts) as k from c where security = cur)
select ts, sum(case when k = 1 and before is not null then open - before else 0 end) over (order by ts) as gap from d""")
def futures_roll(spark, sf_dir):
    return bars.futures_roll(contracts(spark, sf_dir))


@query()
def etf_trick(spark, sf_dir):
    from tickforge.operators.etf import etf_trick as run

    p = panel(spark, sf_dir)
    n = p.select("asset").distinct().count()
    p = p.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ts"))).where(F.col("_n") == n)
    sign = F.when((F.ascii("asset") + F.month("ts")) % 2 == 0, 1.0).otherwise(-0.5)
    return run(p.select("ts", "asset", (F.col("price") * 0.99).alias("open"), F.col("price").alias("close"), sign.alias("alloc"), F.lit(None).cast("double").alias("cost"), F.lit(None).cast("double").alias("rate")))


def embedded(spark, sf_dir):
    """row_id, f0, f1, ..., y, and the names of the features: a column for each component of the embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = [f"f{j}" for j in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    columns = [F.element_at("embedding", j + 1).cast("double").alias(f) for j, f in enumerate(names)]
    return e.select(F.col("vec_id").alias("row_id"), *columns, (F.col("label") < 5).cast("int").alias("y")), names


@query()
def orthogonal_features(spark, sf_dir):
    from tickforge.operators import importance

    df, names = embedded(spark, sf_dir)
    out, value, _ = importance.orthogonal_features(df, names, number=3)
    return out.select("row_id", "PC_0", "PC_1", "PC_2")


@query()
def feature_importance(spark, sf_dir):
    from pyspark.ml.classification import RandomForestClassifier

    from tickforge.operators import importance

    df, names = embedded(spark, sf_dir)
    model = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=8, maxDepth=4, seed=1)
    n = df.count()
    folds = df.select((F.pmod(F.xxhash64("row_id"), F.lit(2))).cast("int").alias("h"), "row_id")
    folds = folds.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("split"), "row_id", "h").select("split", "row_id", F.when(F.col("h") == F.col("split"), "test").otherwise("train").alias("part"))
    mdi = importance.mean_decrease_impurity(model.fit(importance.assembled(df, names)), names)
    mda = importance.mean_decrease_accuracy(model, df, names, "y", folds, scoring="accuracy")
    return spark.createDataFrame([(f, *mdi[f], *mda[f], n) for f in names], "feature string, mdi double, mdi_err double, mda double, mda_err double, n long")


@query()
def feature_clusters(spark, sf_dir):
    from tickforge.operators import importance

    df, names = embedded(spark, sf_dir)
    long = df.select(F.col("row_id").alias("ts"), F.explode(F.array(*[F.struct(F.lit(f).alias("asset"), F.col(f).alias("value")) for f in names])).alias("s")).select("ts", "s.*")
    groups = importance.feature_clusters(long, "spearmans_rho", "angular", "average", 3)
    return spark.createDataFrame([(k, f) for k, g in enumerate(groups) for f in g], "cluster int, feature string")
