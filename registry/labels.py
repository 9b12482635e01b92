"""Labels, masks, weights and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import FEATURES, WEIGHT_SQL, dates, encoded, label_sql, log, query, rounded, star
from registry.splits import SPLIT_SQL
from seatwise.fixtures import EVENTS, STAR, event_spans
from seatwise.operators import labels, quality, scale
from seatwise.operators.months import seat_month_usage, seat_months
from seatwise.operators.grid import mask_by_label
from seatwise.plans.models import part, scale_months, with_split
from seatwise.plans.prep import prep_sequence_baseline
from seatwise.workspace import new_path, stage


def _period_label(alias: str) -> str:
    return label_sql(
        "p.period", f"cast(floor({alias}.create_day / 30.0) as int)", f"cast(floor({alias}.cancel_day / 30.0) as int)", 13
    )


def _long(df, key, name, step):
    return df.select(key, F.posexplode(name).alias(step, "label"))


_DAYS = "cross join (select cast(unnest(range(365)) as int) as day) d"
_PERIODS = "cross join (select cast(unnest(range(13)) as int) as period) p"


@query("daily_labels", star(f"select s.seat_id, d.day, {label_sql('d.day', 's.create_day', 's.cancel_day', 365)} as label from seats s {_DAYS}"))
def _(spark, sf):
    return _long(labels.daily_labels(labels.seat_rollup(dates(spark, sf)), STAR), "seat_id", "label_daily", "day")


@query("monthly_labels", star(f"select s.seat_id, p.period, {_period_label('s')} as label from seats s {_PERIODS}"))
def _(spark, sf):
    return _long(labels.monthly_labels(labels.seat_rollup(dates(spark, sf)), STAR), "seat_id", "label_monthly", "period")


@query(
    "daily_labels_events",
    log("select s.seat_id, d.day, " + label_sql("d.day", "s.create_day", "s.cancel_day", 30) + " as label from spans s cross join (select cast(unnest(range(30)) as int) as day) d"),
)
def _(spark, sf):
    return labels.day_labels(event_spans(spark, sf), EVENTS).select("seat_id", "day", "label")


@query(
    "contract_labels",
    star(f"""select c.contract_id, 'day' as kind, d.day as step, {label_sql('d.day', 'c.create_day', 'c.cancel_day', 365)} as label from contracts c {_DAYS}
union all select c.contract_id, 'period' as kind, p.period as step, {_period_label('c')} as label from contracts c {_PERIODS}"""),
)
def _(spark, sf):
    df = labels.contract_labels(dates(spark, sf), STAR)
    daily = _long(df, "contract_id", "label_daily", "step").withColumn("kind", F.lit("day"))
    monthly = _long(df, "contract_id", "label_monthly", "step").withColumn("kind", F.lit("period"))
    return daily.unionByName(monthly)


@query("contract_rollup", star("select contract_id, create_day, cancel_day from contracts"))
def _(spark, sf):
    return labels.contract_rollup(dates(spark, sf))


@query("lead_labels", star("select contract_id, month, label from contract_label"))
def _(spark, sf):
    periods = labels.period_labels(labels.contract_rollup(dates(spark, sf)), STAR)
    return labels.lead_labels(periods).select("contract_id", "month", "label")


@query(
    "mask_by_label",
    star(f"""select seat_id, month, label, {', '.join(f'case when label <> -1 then {f} else -1 end as {f}' for f in FEATURES)}
from seat_month"""),
)
def _(spark, sf):
    df = labels.with_month_label(seat_month_usage(dates(spark, sf), STAR), STAR)
    df = mask_by_label(df, FEATURES).select("seat_id", "month", "label", *FEATURES)
    return encoded(df, FEATURES)


@query("sample_weights", star(f"select contract_id, month, label, {WEIGHT_SQL} as weight from contract_label"))
def _(spark, sf):
    periods = labels.period_labels(labels.contract_rollup(dates(spark, sf)), STAR)
    df = labels.sample_weights(labels.lead_labels(periods), STAR)
    return df.select("contract_id", "month", "label", "weight")


@query(
    "expand_monthly_to_daily",
    star(f"""select c.contract_id, d.day, case when d.day % 30 = 0 then l.label else 0 end as label,
  case when d.day % 30 = 0 and l.label <> -1 then 1 else 0 end as weight
from contracts c {_DAYS}
join (select c.contract_id, p.period, {_period_label('c')} as label from contracts c {_PERIODS}) l
  on l.contract_id = c.contract_id and l.period = d.day // 30"""),
)
def _(spark, sf):
    periods = labels.period_labels(labels.contract_rollup(dates(spark, sf)), STAR)
    return labels.expand_monthly_to_daily(periods, "contract_id", STAR)


@query(
    "join_seat_contract_labels",
    star("""select s.seat_id, s.contract_id, s.create_day, s.cancel_day, c.create_day as contract_create_day, c.cancel_day as contract_cancel_day
from seats s join contracts c on c.contract_id = s.contract_id"""),
)
def _(spark, sf):
    used = dates(spark, sf)
    df = labels.join_seat_contract_labels(labels.seat_rollup(used), labels.contract_rollup(used))
    days = ["create_day", "cancel_day", "contract_create_day", "contract_cancel_day"]
    return df.select("seat_id", "contract_id", *days)


@query(
    "join_features_labels",
    star(f"""select a.seat_id, a.day, cast(sum(a.session_time) as bigint) as total_time, s.create_day,
  {label_sql('a.day', 's.create_day', 's.cancel_day', 365)} as label
from aged a join seats s on s.seat_id = a.seat_id where a.day between 0 and 364
group by a.seat_id, a.day, s.create_day, s.cancel_day"""),
)
def _(spark, sf):
    from seatwise.functions.vectors import total
    from seatwise.operators.usage import seat_days

    used = dates(spark, sf)
    days = seat_days(used, STAR).select("seat_id", "day", total(STAR.time_features).alias("total_time"))
    df = labels.join_features_labels(days, labels.daily_labels(labels.seat_rollup(used), STAR))
    return df.select(
        "seat_id",
        "day",
        "total_time",
        "create_day",
        F.get("label_daily", F.col("day")).alias("label"),
    )


@query("label_histogram", star("select label, count(*) as n from seat_month group by label"))
def _(spark, sf):
    return quality.label_histogram(seat_months(dates(spark, sf), STAR))


@query("check_mask_consistency", star("""select 'masked' as kind, count(*) as n_cells, count(case when label = -1 and label <> -1 then 1 end) as n_masked_with_features from seat_month
union all select 'unmasked', count(*), count(case when label = -1 then 1 end) from seat_month"""))
def _(spark, sf):
    """Masked months, and months on purpose left unmasked, which the check must find."""
    used = dates(spark, sf)
    unmasked = labels.with_month_label(seat_month_usage(used, STAR), STAR)
    found = quality.check_mask_consistency(seat_months(used, STAR), FEATURES).withColumn("kind", F.lit("masked"))
    return found.unionByName(quality.check_mask_consistency(unmasked, FEATURES).withColumn("kind", F.lit("unmasked")))


_POOLED_SQL = f"""select p.contract_id, p.month, l.label, s.split,
  {', '.join(f'case when l.label <> -1 then p.{f} end as {f}' for f in FEATURES)}
from (select contract_id, month, {', '.join(f'cast(coalesce(sum(case when label <> -1 then {f} end), 0) as double) as {f}' for f in FEATURES)}
      from seat_month group by contract_id, month) p
join contract_label l on l.contract_id = p.contract_id and l.month = p.month
join ({SPLIT_SQL}) s on s.contract_id = p.contract_id"""


def _train_state(kind: str, f: str) -> str:
    return f"{kind}(case when split = 'train' then {f} end)"


def _pooled(spark, sf):
    return with_split(prep_sequence_baseline(dates(spark, sf), STAR))


@query(
    "fit_std_scaler",
    star(f"""select month, {', '.join(f"round(coalesce({_train_state('stddev_pop', f)}, -1), 6) as std_{f}" for f in FEATURES)}
from ({_POOLED_SQL}) group by month"""),
)
def _(spark, sf):
    state = scale.fit_std_scaler(part(_pooled(spark, sf), "train"), FEATURES)
    return rounded(state, [f"std_{f}" for f in FEATURES])


@query(
    "merge_scaler_states",
    star(f"""select month, {', '.join(f"round(coalesce({_train_state('stddev_pop', f)}, -1), 6) as std_{f}" for f in FEATURES)},
  {', '.join(f"round(coalesce({_train_state('avg', f)}, -1), 6) as mean_{f}" for f in FEATURES)}
from ({_POOLED_SQL}) group by month"""),
)
def _(spark, sf):
    """Moments of four parts of the contracts, one part stored twice, merged into the scaler of all training rows."""
    train = stage(part(_pooled(spark, sf), "train"), "train_months")
    path = new_path(spark, "moments")
    for k in (0, 1, 2, 3, 0):
        scale.store_moments(train.filter(F.pmod(F.xxhash64("contract_id"), F.lit(4)) == k), FEATURES, path, str(k))
    state = scale.stored_scaler(spark, FEATURES, path)
    return rounded(state, [f"{kind}_{f}" for kind in ("std", "mean") for f in FEATURES])


@query(
    "apply_std_scaler",
    star(f"""with pooled as ({_POOLED_SQL}),
state as (select month, {', '.join(f"{_train_state('stddev_pop', f)} as std_{f}" for f in FEATURES)} from pooled group by month)
select p.contract_id, p.month, p.split,
  {', '.join(f"round(coalesce(p.{f} / nullif(s.std_{f}, 0), -1), 6) as {f}" for f in FEATURES)}
from pooled p join state s on s.month = p.month"""),
)
def _(spark, sf):
    df = scale_months(_pooled(spark, sf), FEATURES)
    return rounded(df.select("contract_id", "month", "split", *FEATURES), FEATURES)


@query(
    "standardize",
    star(f"""with pooled as ({_POOLED_SQL}),
state as (select month, {', '.join(f"{_train_state('stddev_pop', f)} as std_{f}, {_train_state('avg', f)} as mean_{f}" for f in FEATURES)}
  from pooled group by month)
select p.contract_id, p.month, p.split,
  {', '.join(f"round(coalesce((p.{f} - s.mean_{f}) / nullif(s.std_{f}, 0), -1), 6) as {f}" for f in FEATURES)}
from pooled p join state s on s.month = p.month"""),
)
def _(spark, sf):
    df = _pooled(spark, sf)
    state = scale.fit_standardizer(part(df, "train"), FEATURES)
    df = scale.standardize(df, state, FEATURES)
    return rounded(df.select("contract_id", "month", "split", *FEATURES), FEATURES)
