"""Streams drained over the events table, and the model jobs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from barloom import schemas
from barloom.operators import features as ft
from barloom.operators import metrics, models, newton, risk, samples, tiles, validation
from barloom.plans.oracle import TICKS, bars, bars_of, r
from barloom.plans.registry import query
from barloom.plans.data_queries import BAR_COLS
from barloom.plans.feature_queries import BODY, MIDDLE, UPPER, _times
from barloom.plans.strategy_queries import EMBARGO, FOLD_SQL, GATED, LIVES, _gated, folds
from barloom.session import fresh_dir, store
from barloom.sources import files, views
from barloom.streaming import orders as order_streams
from barloom.streaming import ticks as tick_streams
from barloom.streaming.sinks import drain_append, drain_updates

LATENESS = "10 minutes"


def _events(spark, sf):
    return files.stream_table(spark, sf, schemas.EVENTS, pathGlobFilter="events.parquet")


def _ticks(spark, sf):
    return views.tick_view(_events(spark, sf))


@query("a7_stream_ticks", f"with {TICKS} select tick_id, symbol, ts, price, spread from ticks")
def a7(spark, sf):
    return drain_append(_ticks(spark, sf), "ticks")


@query(
    "a8_audit_log",
    f"""{GATED} select open_ts as ts, account_id, trade_id as order_id, 'risk' as gate,
  case when reason = 'ACCEPT' then 'ACCEPT' else 'REJECT' end as decision, reason from decided""",
)
def a8(spark, sf):
    path = fresh_dir(spark, "audit")
    files.write_audit(risk.audit_rows(_gated(spark, sf)), path)
    return files.read_table(spark, path, schemas.AUDIT)


@query("j1_bars_stream_forming", f"{bars()} select {BAR_COLS} from bars")
def j1_forming(spark, sf):
    live = tick_streams.bars_stream(_ticks(spark, sf), "H1", LATENESS)
    return drain_updates(live, ["symbol", "tf", "bar_ts"], "forming")


@query(
    "j1_bars_stream_closed",
    f"""{bars()} select {BAR_COLS} from bars
  where bar_ts + interval 1 hour <= (select max(ts) - interval 10 minutes from events)""",
)
def j1_closed(spark, sf):
    return drain_append(tick_streams.bars_stream(_ticks(spark, sf), "H1", LATENESS), "closed")


@query("j2_dedupe_stream", f"with {TICKS} select tick_id, symbol, ts, price, spread from ticks")
def j2(spark, sf):
    twice = _ticks(spark, sf).union(_ticks(spark, sf))
    return drain_append(tick_streams.dedupe_stream(twice, ["tick_id"], LATENESS), "unique")


# The clock of a stream is that of the rows it reads, here without quotes; what lies beyond it waits.
CLOCK = """(select date_trunc('milliseconds', max(ts)) - interval 10 minutes from order_events
  where kind <> 'QUOTE')"""
ENDED = LIVES.replace("(select max(ts) as m from events)", f"(select {CLOCK} as m)").replace(
    "as rn from order_events where kind <> 'QUOTE'", f"as rn from order_events where kind <> 'QUOTE' and ts < {CLOCK}"
)


def _landed(spark, sf):
    """The events as a stream of three batches of files, with rows out of order around their edges.

    A period is written by as many tasks as the table is read by, and a trigger takes a period's files.
    """
    rows = views.events(spark, sf)
    tasks = rows.rdd.getNumPartitions()
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
    path, third = fresh_dir(spark, "landed-events"), (hi - lo) / 3
    shifted = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 2 * 5).cast("int"))
    part = (shifted >= F.lit(lo + third).cast("timestamp_ntz")).cast("int") + (
        shifted >= F.lit(lo + 2 * third).cast("timestamp_ntz")
    ).cast("int")
    for i in range(3):
        rows.filter(part == i).repartition(tasks).write.mode("append").parquet(path)
    return files.stream_table(spark, path, schemas.EVENTS, files_per_trigger=tasks)


@query(
    "j3_order_fsm",
    f"{ENDED} select order_id, event_id, placed, state, ended from lives where state <> 'PENDING'",
)
def j3(spark, sf):
    log = views.order_event_view(_landed(spark, sf))
    return drain_append(order_streams.order_fsm(log, 86_400, LATENESS), "orders")


@query(
    "j5_risk_gate_stream",
    f"""{GATED} select trade_id, account_id, open_ts, reason,
  case when reason = 'ACCEPT' then 'ACCEPT' else 'REJECT' end as decision from decided
  where open_ts < (select date_trunc('milliseconds', max(ts)) - interval 10 minutes from events)""",
)
def j5_stream(spark, sf):
    offers = views.offers_view(_landed(spark, sf))
    gated = order_streams.risk_gate_stream(offers, 0.4, 2, 40.0, LATENESS)
    return drain_append(gated, "gated")


@query(
    "j6_features_stream",
    f"""{bars()} select symbol, bar_ts, {r('''greatest(high - low, coalesce(abs(high - lag(close) over w), 0),
  coalesce(abs(low - lag(close) over w), 0))''')} as tr, {r('4 * (stddev_pop(close) over v) / (avg(close) over v)')}
  as bb_width from bars window w as (partition by symbol order by bar_ts),
  v as (partition by symbol order by bar_ts rows between 19 preceding and current row)""",
)
def j6(spark, sf):
    path = fresh_dir(spark, "live-features")
    landed = f"{path}/landed"
    table = views.bars(spark, sf).drop("bar_no")
    # Bars land in three periods; the stream picks each up where the last one ended.
    edges = [F.lit(t).cast("timestamp_ntz") for t in _times(table)]
    period = (F.col("bar_ts") >= edges[0]).cast("int") + (F.col("bar_ts") >= edges[1]).cast("int")
    for i in range(3):
        table.filter(period == i).write.mode("append").parquet(landed)
        stream = files.stream_table(spark, landed, schemas.BARS)
        tick_streams.features_stream(
            stream, f"{path}/tail", f"{path}/out", f"{path}/checkpoint", [ft.true_range(), ft.bb_width()]
        ).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("symbol", "bar_ts", "tr", "bb_width")


@query(
    "j7_autopilot_stream",
    f"""{bars()}, f as (select symbol, bar_ts, avg(case when up then 1e0 else 0e0 end) over (partition by symbol
  order by bar_ts rows between 10 preceding and 1 preceding) as p_bull, n from (select *, close > open as up,
  row_number() over (partition by symbol order by bar_ts) as n from bars))
  select symbol, bar_ts, {r('greatest(p_bull, 1 - p_bull)')} as confidence from f
  where n > 10 and greatest(p_bull, 1 - p_bull) > 0.7""",
)
def j7(spark, sf):
    def share(df, w):
        up = (F.col("close") > F.col("open")).cast("double")
        return df.withColumn("_up", up).withColumn("p_bull", F.avg("_up").over(w.rowsBetween(-10, -1)))

    made = tiles.tiled(views.bars(spark, sf), share, before=10).filter(F.col("bar_no") >= 10)
    path = fresh_dir(spark, "forecasts")
    made.select(
        "symbol", "bar_ts", F.greatest("p_bull", 1 - F.col("p_bull")).alias("confidence")
    ).write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = files.stream_table(spark, path, schema)
    return drain_append(tick_streams.autopilot_stream(stream, 0.70), "autopilot")


APPROVALS = (
    ENDED.replace("'signup' then 'PLACE' when 'purchase' then 'FILL' when 'click' then 'CANCEL'",
                  "'signup' then 'PLACE' when 'purchase' then 'APPROVE'")
    .replace("when 'error' then 'REJECT'", "when 'error' then 'DECLINE'")
    .replace("""when l.kind = 'FILL' then 'FILLED' when l.kind = 'CANCEL' then 'CANCELLED' when l.kind = 'REJECT' then 'REJECTED'""",
             """when l.kind = 'APPROVE' then 'APPROVED' when l.kind = 'DECLINE' then 'REJECTED'""")
)


@query(
    "j8_approvals",
    f"{APPROVALS} select order_id, event_id, placed, state, ended from lives where state <> 'PENDING'",
)
def j8(spark, sf):
    kind = (
        F.when(F.col("event_type") == "signup", "PROPOSE")
        .when(F.col("event_type") == "purchase", "APPROVE")
        .when(F.col("event_type") == "error", "DECLINE")
    )
    log = _landed(spark, sf).select("event_id", F.col("user_id").alias("order_id"), "ts", kind.alias("kind"))
    endings = {"APPROVE": "APPROVED", "DECLINE": "REJECTED"}
    return drain_append(order_streams.order_fsm(log, 86_400, LATENESS, "PROPOSE", endings), "approvals")


@query(
    "e9_fills_stream",
    f"""with {TICKS}, {bars_of('M5')} select o.tick_id as order_id, o.symbol, o.ts,
  {r('o.price / 2')} as entry, min(b.bar_ts) as fill_ts from ticks o join bars b on b.symbol = o.symbol
  and b.bar_ts > o.ts and b.bar_ts <= o.ts + interval 2 hours and b.low <= o.price / 2 group by 1, 2, 3, 4""",
)
def e9(spark, sf):
    fills = tick_streams.fills_stream(*_resting(spark, sf), 7200, LATENESS)
    return tick_streams.first_fill(drain_append(fills, "fills"))


def _resting(spark, sf):
    """A stream of buy orders at half the tick's price, and one of five-minute bars."""
    path = fresh_dir(spark, "landed-bars")
    files.write_immutable(views.bars(spark, sf, "M5").drop("bar_no"), path, "landed")
    live = files.stream_table(spark, path, schemas.BARS)
    orders = _ticks(spark, sf).select(
        F.col("tick_id").alias("order_id"), "symbol", "ts", (F.col("price") / 2).alias("entry")
    )
    return orders, live


@query(
    "e9_first_fills_stream",
    f"""with {TICKS}, {bars_of('M5')}, c as (select date_trunc('milliseconds', least((select max(ts) from ticks),
  (select max(bar_ts) from bars))) - interval 130 minutes as t) select o.tick_id as order_id, o.symbol, o.ts,
  {r('o.price / 2')} as entry, min(b.bar_ts) as fill_ts from ticks o join bars b on b.symbol = o.symbol
  and b.bar_ts > o.ts and b.bar_ts <= o.ts + interval 2 hours and b.low <= o.price / 2
  where o.ts < (select t from c) group by 1, 2, 3, 4""",
)
def e9_first(spark, sf):
    """The stream's own rows; orders that bars may still fill earlier wait, as the SQL says by its clock."""
    return drain_append(tick_streams.first_fills_stream(*_resting(spark, sf), 7200, LATENESS), "first-fills")


# --- models ---------------------------------------------------------------

def _parts(spark, sf):
    """Training rows whose labels end before the middle of the bars' time, and the rows after it."""
    bars_ = views.bars(spark, sf)
    table = store(models.training_table(bars_), "training")
    cut = F.lit(_times(bars_)[0]).cast("timestamp_ntz")
    return table.filter(F.col("label_end") < cut), table.filter(F.col("bar_ts") >= cut)


def _late_rows(spark, sf):
    """All bars from the middle on that can be scored, the newest included."""
    bars_ = views.bars(spark, sf)
    return models.scoring_table(bars_).filter(F.col("bar_ts") >= F.lit(_times(bars_)[0]).cast("timestamp_ntz"))


LATE_BARS = f"{bars()} select symbol, count(*) as n from bars where bar_ts >= {MIDDLE} group by 1"


@query("h1_scored_rows", LATE_BARS)
def h1_rows(spark, sf):
    """Fit, save, load and score: every bar of the later half gets one score."""
    uri = models.save(models.fit_direction(_parts(spark, sf)[0]), fresh_dir(spark, "model"))
    scored = models.score(_late_rows(spark, sf), uri).filter(F.col("p_bull").between(0, 1))
    return scored.groupBy("symbol").agg(F.count("*").alias("n"))


@query("h2_scored_rows", LATE_BARS)
def h2_rows(spark, sf):
    train = _parts(spark, sf)[0]
    uri = models.save(models.fit_gbt(train, _valid_from(train)), fresh_dir(spark, "model"))
    scored = models.score(_late_rows(spark, sf), uri).filter(F.col("p_bull").between(0, 1))
    return scored.groupBy("symbol").agg(F.count("*").alias("n"))


@query("h3_score_trees", LATE_BARS.replace("as n from", "as n, 0::bigint as n_apart from"))
def h3_trees(spark, sf):
    """Boosted trees scored from their file; n_apart counts rows over 1e-9 away from the fitted model's own."""
    train = _parts(spark, sf)[0]
    model = models.fit_gbt(train, _valid_from(train))
    uri = models.save_trees(spark, model, fresh_dir(spark, "trees"))
    rows = models.apply_direction(model, _late_rows(spark, sf)).withColumnRenamed("p_bull", "p_own")
    scored = models.score_file(rows, uri, models.load_trees, models.predict_trees, models.INPUTS, "p_file")
    apart = F.abs(F.col("p_file") - F.col("p_own")) > 1e-9
    return scored.groupBy("symbol").agg(F.count("p_file").alias("n"), F.count_if(apart).alias("n_apart"))


def _valid_from(train):
    """The last quarter of the training time is held out."""
    return F.lit(_times(train)[1]).cast("timestamp_ntz")


def _judged(scored):
    up = scored.withColumn("up", F.col("label") > 0)
    return metrics.direction_metrics(up, ["symbol"], "p_bull", "up")


@query("h1_fit_direction")
def h1(spark, sf):
    train, test = _parts(spark, sf)
    return _judged(models.apply_direction(models.fit_direction(train), test))


@query("h2_fit_gbt")
def h2(spark, sf):
    train, test = _parts(spark, sf)
    model = models.fit_gbt(train, _valid_from(train))
    return _judged(models.apply_direction(model, test))


# A linear model for samples of 8 closes: weights on the returns against the last close.
WEIGHTS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35)


@query(
    "h3_score",
    f"""{bars()}, n as (select *, row_number() over (partition by symbol order by bar_ts) as rn from bars),
  z as (select symbol, bar_ts, rn, close, lead(close) over w as y,
  {' + '.join(f'{w}e0 * (lag(close, {7 - i}) over w / close - 1)' for i, w in enumerate(WEIGHTS))} as s
  from n window w as (partition by symbol order by bar_ts))
  select symbol, bar_ts, {r('1 / (1 + exp(-s))')} as p_bull from z where rn >= 8 and y is not null""",
)
def h3(spark, sf):
    made = samples.windows(views.bars(spark, sf), ["close"], length=8, horizon=1)
    rows = made.withColumn("x", F.transform("x", lambda v: v.close))
    uri = models.save_weights(spark, WEIGHTS, fresh_dir(spark, "weights"))
    return models.score_samples(rows, uri, "x", "p_bull").select("symbol", "bar_ts", "p_bull")


@query("g1_walk_forward")
def g1(spark, sf):
    def fit(train):
        model = models.fit_direction(train)
        return lambda test: models.apply_direction(model, test)

    scored = _walked(spark, sf, fit)
    return metrics.direction_metrics(
        scored.withColumn("up", F.col("label") > 0), ["fold"], "p_bull", "up"
    )


def _walked(spark, sf, fit):
    bars_ = views.bars(spark, sf)
    return validation.walk_forward(models.training_table(bars_), folds(bars_), EMBARGO, fit)


@query(
    "g1_fold_rows",
    f"""{bars()}, {FOLD_SQL}, n as (select *, lead(bar_ts) over (partition by symbol order by bar_ts) as label_end from bars)
  select fold, count(*) as n from n join f on bar_ts >= lo and bar_ts < hi where label_end is not null group by 1""",
)
def g1_rows(spark, sf):
    """Every labelled bar of a test period is scored once, here by its training rows' mean."""
    def fit(train):
        mean = train.agg(F.avg("label")).first()[0]
        return lambda test: test.withColumn("p_bull", F.lit(mean))

    return _walked(spark, sf, fit).groupBy("fold").agg(F.count("p_bull").alias("n"))


# Two inputs, so that SQL can solve a step's three equations.
SHAPE, STEPS = ("body_ratio", "upper_wick"), 9


def _step(i: int) -> str:
    """Newton step i of all folds: sums over the rows, then the inverse of a symmetric 3 x 3 matrix."""
    return f"""g{i} as materialized (select fold, any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2,
  avg(p - y) as g0, avg((p - y) * z1) + 0.01e0 * any_value(b1) as g1, avg((p - y) * z2) + 0.01e0 * any_value(b2) as g2,
  avg(p * (1 - p)) as h00, avg(p * (1 - p) * z1) as h01, avg(p * (1 - p) * z2) as h02,
  avg(p * (1 - p) * z1 * z1) + 0.01e0 as h11, avg(p * (1 - p) * z1 * z2) as h12, avg(p * (1 - p) * z2 * z2) + 0.01e0 as h22
  from (select z.*, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) as p from z join b{i - 1} using (fold)) group by fold),
  b{i} as materialized (select fold, b0 - (c00 * g0 + c01 * g1 + c02 * g2) / det as b0,
  b1 - (c01 * g0 + c11 * g1 + c12 * g2) / det as b1, b2 - (c02 * g0 + c12 * g1 + c22 * g2) / det as b2 from (select *,
  h11 * h22 - h12 * h12 as c00, h02 * h12 - h01 * h22 as c01, h01 * h12 - h02 * h11 as c02, h00 * h22 - h02 * h02 as c11,
  h01 * h02 - h00 * h12 as c12, h00 * h11 - h01 * h01 as c22,
  h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as det from g{i}))"""


def _newton(fold_sql: str, embargo: str) -> str:
    """Tables t (rows with inputs and label), f (folds) and w (their weights)."""
    return f"""{bars()}, {fold_sql}, t as materialized (select * from (select symbol, bar_ts, {BODY} as x1, {UPPER} as x2,
  lead(bar_ts) over w as label_end, case when lead(close) over w > close then 1e0 else 0e0 end as y
  from bars window w as (partition by symbol order by bar_ts)) where label_end is not null),
  tr as materialized (select fold, x1, x2, y from t join f on label_end < lo - interval {embargo}),
  m as materialized (select fold, avg(x1) as m1, avg(x2) as m2, stddev_samp(x1) as s1, stddev_samp(x2) as s2,
  avg(y) as my from tr group by 1), z as materialized (select fold, (x1 - m1) / s1 as z1, (x2 - m2) / s2 as z2, y
  from tr join m using (fold)), b0 as (select fold, ln(my / (1 - my)) as b0, 0e0 as b1, 0e0 as b2 from m),
  {', '.join(_step(i) for i in range(1, STEPS + 1))},
  w as (select fold, b0 - b1 * m1 / s1 - b2 * m2 / s2 as intercept, b1 / s1 as w1, b2 / s2 as w2
  from b{STEPS} join m using (fold)), s as (select symbol, fold, y, 1 / (1 + exp(-(intercept + w1 * x1 + w2 * x2))) as q
  from t join f on bar_ts >= lo and bar_ts < hi join w using (fold))"""


JUDGED = f"""count(*) as n, {r('avg(case when (q > 0.5) = (y > 0) then 1e0 else 0e0 end)')} as accuracy,
  {r('avg(-(y * ln(q) + (1 - y) * ln(1 - q)))')} as log_loss, {r('avg((q - y) * (q - y))')} as brier from s"""
HALF_SQL = f"f as (select 1::int as fold, {MIDDLE} as lo, (select max(bar_ts) from bars) + interval 1 hour as hi)"


def _shapes(spark, sf):
    made = ft.compute(views.bars(spark, sf), ft.body_ratio(), ft.wick_ratios(), models.next_bar())
    return made.select(*tiles.SERIES, "bar_ts", "label_end", "label", *SHAPE).dropna()


def _scored(rows, folds_, embargo):
    rows = store(rows, "shapes")
    return newton.score_folds(rows, folds_, newton.fit_folds(rows, folds_, embargo, SHAPE), SHAPE).withColumn("up", F.col("label") > 0)


@query("g1_newton_folds", f"{_newton(FOLD_SQL, '6 hours')} select fold, {JUDGED} group by 1")
def g1_newton(spark, sf):
    """Out-of-sample metrics of every fold; all folds are fitted by the same jobs."""
    scored = _scored(_shapes(spark, sf), folds(views.bars(spark, sf)), EMBARGO)
    return metrics.direction_metrics(scored, ["fold"], "p_bull", "up")


@query(
    "g1_newton_weights",
    f"""{_newton(FOLD_SQL, '6 hours')} select fold, {r('intercept')} as intercept, {r('w1')} as body_ratio,
  {r('w2')} as upper_wick from w""",
)
def g1_weights(spark, sf):
    rows = _shapes(spark, sf)
    return newton.weights_table(rows, newton.fit_folds(rows, folds(views.bars(spark, sf)), EMBARGO, SHAPE), SHAPE)


@query("h1_newton_direction", f"{_newton(HALF_SQL, '0 hours')} select symbol, {JUDGED} group by 1")
def h1_newton(spark, sf):
    """A direction model of the first half of the time, judged on the second."""
    bars_ = views.bars(spark, sf)
    newest = bars_.agg(F.max("bar_ts")).first()[0]
    scored = _scored(_shapes(spark, sf), [(1, _times(bars_)[0], newest + timedelta(hours=1))], timedelta(0))
    return metrics.direction_metrics(scored, ["symbol"], "p_bull", "up")
