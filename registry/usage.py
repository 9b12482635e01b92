"""Interval joins and sums of assigned usage."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from registry.core import (
    CATEGORIES,
    EVENTS,
    FEATURES,
    LOG_FEATURES,
    assigned,
    dates,
    encoded,
    log,
    query,
    star,
    sums_sql,
    text,
)
from seatwise.fixtures import (
    STAR,
    event_sessions,
    event_spans,
    event_usage,
    star_assignment,
    star_taxonomy,
    star_usage,
)
from seatwise.operators import assign, grid, months, observed, quality, usage
from seatwise.operators.clean import clean_assignments
from seatwise.operators.layout import EventLayout, add_events, assigned_from_layout
from seatwise.operators.labels import seat_rollup
from seatwise.plans.prep import contract_month_features, dated_usage, seat_samples
from seatwise.streaming.monthly import ingest_months
from seatwise.workspace import new_path, stage
from seatwise.operators.sweep import interval_join_sweep

_ASSIGNED_SQL = """select member_id, product_name, session_time, strftime(event_date, '%Y-%m-%d') as event_date,
  contract_id, seat_id, strftime(seat_cancelled_date, '%Y-%m-%d') as seat_cancelled_date,
  strftime(contract_cancelled_date, '%Y-%m-%d') as contract_cancelled_date,
  strftime(create_date, '%Y-%m-%d') as create_date from assigned"""
_DATES = ["event_date", "seat_cancelled_date", "contract_cancelled_date", "create_date"]


def _assigned_columns(df):
    return df.select(
        "member_id", "product_name", "session_time", "contract_id", "seat_id", *[text(c) for c in _DATES]
    )


def _prepared(spark, sf):
    events = assign.prepare_usage(star_usage(spark, sf), star_taxonomy(spark, sf), STAR)
    return events, clean_assignments(star_assignment(spark, sf), STAR)


@query("interval_join_usage", star(_ASSIGNED_SQL))
def _(spark, sf):
    return _assigned_columns(assign.interval_join_bucketed(*_prepared(spark, sf), STAR.bucket_days, floor=50, distinct=True))


@query("interval_join_bucketed", star(_ASSIGNED_SQL))
def _(spark, sf):
    # Low limits, so that members are split even in small tables.
    window = (STAR.event_from, STAR.event_to)
    df = assign.interval_join_bucketed(*_prepared(spark, sf), bucket_days=7, window=window, share=1e-5, floor=2, distinct=True)
    return _assigned_columns(df)


_LOG_JOIN_SQL = """select member_id, seat_id, contract_id, product_name, session_time, day from joined"""


def _log_joined(spark, sf):
    events, sessions = event_usage(spark, sf), event_sessions(spark, sf)
    df = assign.interval_join_bucketed(events, sessions, EVENTS.bucket_days, (EVENTS.event_from, EVENTS.event_to))
    return usage.with_day(usage.with_day_zero(df, EVENTS))


@query("interval_join_sweep", star(_ASSIGNED_SQL))
def _(spark, sf):
    """The sweep over time, with both sides of busy members split."""
    events, sessions = _prepared(spark, sf)
    return _assigned_columns(interval_join_sweep(events.dropDuplicates(), sessions, 30, (STAR.event_from, STAR.event_to), share=1e-4, floor=20))


@query("interval_join_events", log(_LOG_JOIN_SQL))
def _(spark, sf):
    df = _log_joined(spark, sf)
    return df.select("member_id", "seat_id", "contract_id", "product_name", "session_time", "day")


@query("assigned_usage", star(_ASSIGNED_SQL))
def _(spark, sf):
    return _assigned_columns(assigned(spark, sf))


@query("assigned_usage_split", star(_ASSIGNED_SQL))
def _(spark, sf):
    """With a floor so low that members are split at any size."""
    return _assigned_columns(assigned(spark, sf, replace(STAR, hot_floor=2)))


@query("ingest_months", star(_ASSIGNED_SQL))
def _(spark, sf):
    base, out = new_path(spark, "monthly_usage"), new_path(spark, "assigned")
    events = star_usage(spark, sf)
    events.withColumn("month", F.date_format("event_time", "yyyy-MM")).write.partitionBy("month").parquet(base)
    sessions = clean_assignments(star_assignment(spark, sf), STAR)
    ingest_months(spark, base, star_taxonomy(spark, sf), sessions, STAR, out).awaitTermination()
    return _assigned_columns(spark.read.parquet(out))


def _third(events):
    """Events dealt over three arrivals, whole months late or early, members apart."""
    return events.withColumn("_arrival", F.pmod(F.xxhash64("member_id", F.date_format("event_time", "yyyy-MM")), F.lit(3)))


@query("laid_out_usage", star(_ASSIGNED_SQL))
def _(spark, sf):
    """Events added to a layout in three batches, the last with copies of the others, then joined where they lie."""
    layout = EventLayout(new_path(spark, "layout"), 8)
    events, sessions = _prepared(spark, sf)
    events = _third(events)
    for batch in range(3):
        add_events(layout, events.filter((F.col("_arrival") == batch) | F.lit(batch == 2)), batch, share=1e-4, floor=20)
    return _assigned_columns(assigned_from_layout(layout, sessions, STAR))


@query(
    "sum_by_category",
    star("select a.seat_id, " + ", ".join(
        f"cast(sum(case when a.product_name = '{c}' then a.session_time else 0 end) as bigint) as time_{c}" for c in CATEGORIES
    ) + " from assigned a group by a.seat_id"),
)
def _(spark, sf):
    return usage.sum_by_category(assigned(spark, sf), ["seat_id"], CATEGORIES)


@query(
    "count_by_category",
    star("select a.contract_id, " + ", ".join(
        f"cast(sum(case when a.product_name = '{c}' then 1 else 0 end) as bigint) as count_{c}" for c in CATEGORIES
    ) + " from assigned a group by a.contract_id"),
)
def _(spark, sf):
    return usage.count_by_category(assigned(spark, sf), ["contract_id"], CATEGORIES)


@query(
    "daily_feature_vector",
    star(f"select a.seat_id, a.day, {sums_sql()} from aged a where a.day between 0 and 364 group by a.seat_id, a.day"),
)
def _(spark, sf):
    df = usage.daily_feature_vector(dates(spark, sf), STAR)
    return df.select(
        "seat_id", "day", *[F.col("f")[i].alias(f) for i, f in enumerate(FEATURES)]
    )


@query(
    "pivot_days",
    log("select seat_id, " + ", ".join(
        f"cast(coalesce(sum(case when day = {d} then session_time end), -1) as bigint) as d{d}" for d in range(30)
    ) + " from joined group by seat_id"),
)
def _(spark, sf):
    df = usage.pivot_days(_log_joined(spark, sf), "seat_id", range(30), F.sum("session_time"))
    df = df.select("seat_id", *[F.col(str(d)).alias(f"d{d}") for d in range(30)])
    return encoded(df, [f"d{d}" for d in range(30)])


@query("global_min_date", star("select strftime(day_zero, '%Y-%m-%d') as day_zero from day0"))
def _(spark, sf):
    return usage.global_min_date(assigned(spark, sf)).select(text("day_zero"))


@query("category_vocabulary", star("select distinct product_name as category from assigned"))
def _(spark, sf):
    return usage.category_vocabulary(assigned(spark, sf))


@query(
    "monthly_sum",
    star(f"""select a.seat_id, cast(floor(a.day / 30.0) as int) as month, {sums_sql()}
from aged a where a.day % 30 < 29 and a.day between 0 and 359 group by all"""),
)
def _(spark, sf):
    return months.monthly_sum(usage.seat_days(dates(spark, sf), STAR), STAR)


@query(
    "lifetime_sum",
    star(f"select seat_id, month, {', '.join('life_' + f for f in FEATURES)} from seat_month"),
)
def _(spark, sf):
    df = months.seat_month_usage(dates(spark, sf), STAR, lifetime=True)
    return df.select("seat_id", "month", *STAR.lifetime_features)


def log_days(spark, sf):
    return _log_joined(spark, sf).groupBy("seat_id", "day").agg(
        *usage.time_sums(EVENTS.categories), *usage.count_sums(EVENTS.categories)
    )


_LOG_SUMS = ", ".join(
    [f"cast(coalesce(sum(case when j.product_name = '{c}' then j.session_time end), 0) as bigint) as time_{c}" for c in EVENTS.categories]
    + [f"count(case when j.product_name = '{c}' then 1 end) as count_{c}" for c in EVENTS.categories]
)


@query(
    "zero_fill_life",
    log(f"""select s.seat_id, d.day, {_LOG_SUMS}
from spans s join (select cast(unnest(range(30)) as int) as day) d on d.day between s.create_day and s.cancel_day
left join joined j on j.seat_id = s.seat_id and j.day = d.day group by s.seat_id, d.day"""),
)
def _(spark, sf):
    return grid.zero_fill_life(log_days(spark, sf), event_spans(spark, sf), LOG_FEATURES, EVENTS.horizon_days)


_ALIVE = "d.day between s.create_day and s.cancel_day"


@query(
    "dense_grid",
    log(f"""select s.seat_id, d.day, case when {_ALIVE} then 1 else 0 end as present,
  {', '.join(f'case when {_ALIVE} then coalesce(u.time_{c}, 0) else -1 end as time_{c}' for c in EVENTS.categories)}
from spans s cross join (select cast(unnest(range(30)) as int) as day) d
left join (select j.seat_id, j.day, {_LOG_SUMS} from joined j group by j.seat_id, j.day) u
  on u.seat_id = s.seat_id and u.day = d.day"""),
)
def _(spark, sf):
    times = EVENTS.time_features
    df = grid.dense_days(log_days(spark, sf), event_spans(spark, sf), times, EVENTS.horizon_days)
    present = F.col(times[0]).isNotNull().cast("int").alias("present")
    df = df.select("seat_id", "day", present, *times)
    return encoded(df, times)


@query(
    "seat_samples",
    star(f"""select s.seat_id, s.contract_id, count(distinct a.day) as n_days,
  cast(sum(a.session_time) as bigint) as total_time, count(*) as total_count,
  s.create_day as seat_create, s.cancel_day as seat_cancel, c.create_day as contract_create, c.cancel_day as contract_cancel,
  greatest(0, least(s.cancel_day, 365) - s.create_day) as alive_seat_days,
  case when s.cancel_day between 0 and 364 then 1 else 0 end as churn_seat_days,
  greatest(0, least(floor(s.cancel_day / 30.0), 13) - floor(s.create_day / 30.0))::int as alive_seat_periods,
  greatest(0, least(c.cancel_day, 365) - c.create_day) as alive_contract_days,
  greatest(0, least(floor(c.cancel_day / 30.0), 13) - floor(c.create_day / 30.0))::int as alive_contract_periods
from seats s join contracts c on c.contract_id = s.contract_id join aged a on a.seat_id = s.seat_id
group by all"""),
)
def _(spark, sf):
    df = seat_samples(dates(spark, sf), STAR)
    n = len(CATEGORIES)
    cells = F.flatten(F.transform("x", lambda c: F.slice(c["f"], 1, n)))
    counts = F.flatten(F.transform("x", lambda c: F.slice(c["f"], n + 1, n)))

    def add(values):
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v)

    def how_many(labels, value):
        return F.size(F.filter(labels, lambda v: v == value))

    return df.select(
        "seat_id",
        "contract_id",
        F.size("x").cast("bigint").alias("n_days"),
        add(cells).alias("total_time"),
        add(counts).alias("total_count"),
        "seat_create", "seat_cancel", "contract_create", "contract_cancel",
        how_many("label_seat_daily", 0).alias("alive_seat_days"),
        how_many("label_seat_daily", 1).alias("churn_seat_days"),
        how_many("label_seat_monthly", 0).alias("alive_seat_periods"),
        how_many("label_contract_daily", 0).alias("alive_contract_days"),
        how_many("label_contract_monthly", 0).alias("alive_contract_periods"),
    )


@query(
    "distinct_counts",
    star("""select count(*) as n_rows, count(distinct member_id) as n_member_id, count(distinct seat_id) as n_seat_id,
  count(distinct contract_id) as n_contract_id from assigned"""),
)
def _(spark, sf):
    return quality.distinct_counts(assigned(spark, sf), ["member_id", "seat_id", "contract_id"])


_FD = ["contract_id", "create_date", "seat_cancelled_date", "member_id"]


@query(
    "check_functional_dependency",
    star(" union all ".join(
        f"select '{c}' as \"column\", count(*) as violations from (select seat_id from assigned group by seat_id having count(distinct {c}) > 1)"
        for c in _FD
    )),
)
def _(spark, sf):
    df = assigned(spark, sf).withColumns({c: F.col(c).cast("string") for c in _FD})
    return quality.check_functional_dependency(df, "seat_id", _FD)


@query("check_event_after_create", star("select count(case when event_date < create_date then 1 end) as n_before_create from assigned"))
def _(spark, sf):
    return quality.check_event_after_create(assigned(spark, sf))


_COUNTED = ["member_id", "seat_id", "contract_id"]


@query(
    "observed_figures",
    star(f"""select a.*, m.* from (select count(case when event_date < create_date then 1 end) as n_before_create, count(*) as n_events from assigned) a
cross join (select count(*) as n_cells, 0::bigint as n_masked_with_features, count(case when label = -1 then 1 end) as n_label_m1,
  count(case when label = 0 then 1 end) as n_label_0, count(case when label = 1 then 1 end) as n_label_1, 0::bigint as n_label_other from seat_month) m"""),
)
def _(spark, sf):
    """The checks' figures, taken along while assigned usage and seat months are written."""
    table, found = observed.observed_stage(assigned(spark, sf), "assigned", observed.create_figures() | {"n_events": F.count(F.lit(1))})
    cells = observed.mask_figures(FEATURES) | observed.label_figures()
    found |= observed.observed_stage(months.seat_months(dated_usage(table, STAR), STAR), "seat_months", cells)[1]
    return spark.createDataFrame([found], ", ".join(f"{n} bigint" for n in found))


@query(
    "sketched_counts",
    star("select count(*) as n_rows, " + ", ".join(f"count(distinct {c}) > 0 as {c}_agrees" for c in _COUNTED) + " from assigned"),
)
def _(spark, sf):
    """Sketches by month of the event, stored and merged, within 4 % (five standard errors) of the exact counts."""
    table, path = stage(assigned(spark, sf), "assigned"), new_path(spark, "sketches")
    observed.store_sketches(observed.month_sketches(table, _COUNTED, F.date_format("event_date", "yyyy-MM")), path)
    exact = quality.distinct_counts(table, _COUNTED).select(F.struct(*[f"n_{c}" for c in _COUNTED])).scalar()
    near = [(F.abs(F.col(f"n_{c}") - exact[f"n_{c}"]) <= exact[f"n_{c}"] * 0.04).alias(f"{c}_agrees") for c in _COUNTED]
    return observed.stored_counts(spark, path, _COUNTED).select("n_rows", *near)


@query(
    "contract_month_features",
    star(f"""select p.contract_id, p.month, l.label,
  case l.label when 1 then 50.0::double when 0 then 1.0::double else 0.0::double end as weight,
  {', '.join(f'case when l.label <> -1 then p.{f} else -1 end as {f}' for f in FEATURES)},
  case when l.label <> -1 and p.n_seats > 0 then p.n_seats else -1 end as n_seats
from (select contract_id, month, {', '.join(f'cast(coalesce(sum(case when label <> -1 then {f} end), 0) as bigint) as {f}' for f in FEATURES)},
        count(case when label <> -1 then 1 end) as n_seats
      from seat_month group by contract_id, month) p
join contract_label l on l.contract_id = p.contract_id and l.month = p.month"""),
)
def _(spark, sf):
    df = contract_month_features(
        star_assignment(spark, sf), star_usage(spark, sf), star_taxonomy(spark, sf), STAR
    )
    return encoded(df, [*FEATURES, "n_seats"])


@query(
    "seat_rollup",
    star("select seat_id, contract_id, create_day, cancel_day from seats"),
)
def _(spark, sf):
    return seat_rollup(dates(spark, sf))
