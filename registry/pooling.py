"""Seats pooled into contracts, and the model input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.usage import log_days
from registry.core import CATEGORIES, FEATURES, LOG_FEATURES, WEIGHT_SQL, dates, encoded, label_sql, log, query, rounded, star, sums_sql
from seatwise.fixtures import EVENTS, STAR, event_spans
from seatwise.functions.vectors import squeeze_array
from seatwise.operators import grid, labels, pool
from seatwise.operators.months import seat_month_usage, seat_months
from seatwise.operators.usage import pack_features
from seatwise.plans import prep

LIFE = STAR.lifetime_features


def _masked(f: str) -> str:
    return f"case when label <> -1 then {f} end"


def _sum_pool(features) -> str:
    sums = ", ".join(f"cast(coalesce(sum({_masked(f)}), 0) as bigint) as {f}" for f in features)
    return f"select contract_id, month, {sums}, count({_masked(features[0])}) as n_seats from seat_month group by contract_id, month"


def _labelled(pooled: str, columns: str) -> str:
    weight = WEIGHT_SQL.replace("case label", "case l.label")
    return star(f"""select p.contract_id, p.month, l.label, {weight} as weight, {columns}
from ({pooled}) p join contract_label l on l.contract_id = p.contract_id and l.month = p.month""")


def _shown(features) -> str:
    return ", ".join(f"case when l.label <> -1 then p.{f} else -1 end as {f}" for f in features)


_COUNT_OR_MISSING = "case when l.label <> -1 and p.n_seats > 0 then p.n_seats else -1 end as n_seats"


@query(
    "pool_sum",
    star(_sum_pool(FEATURES).replace(f"count({_masked(FEATURES[0])}) as n_seats", f"case when count({_masked(FEATURES[0])}) = 0 then -1 else count({_masked(FEATURES[0])}) end as n_seats")),
)
def _(spark, sf):
    return encoded(pool.pool_sum(seat_months(dates(spark, sf), STAR), FEATURES), ["n_seats"])


_KINDS = {"mean": "avg", "max": "max", "min": "min"}


def _mmm(features) -> str:
    parts = [
        f"round(coalesce({how}(cast({_masked(f)} as double)), 0), 6) as {kind}_{f}" for kind, how in _KINDS.items() for f in features
    ]
    return f"select contract_id, month, {', '.join(parts)}, count({_masked(features[0])}) as n_seats from seat_month group by contract_id, month"


@query("pool_mean_max_min", star(_mmm(FEATURES)))
def _(spark, sf):
    df = pool.pool_mean_max_min(seat_months(dates(spark, sf), STAR), FEATURES)
    return rounded(df, pool.pooled_names(FEATURES))


@query("prep_pooled", _labelled(_mmm(FEATURES), _shown(pool.pooled_names(FEATURES)) + ", " + _shown(["n_seats"])))
def _(spark, sf):
    used = dates(spark, sf)
    df = prep.prep_pooled(seat_months(used, STAR), used, FEATURES, STAR)
    return encoded(rounded(df, pool.pooled_names(FEATURES)), ["n_seats"])


@query(
    "pool_presence",
    log(f"""select contract_id, day,
  {', '.join(f"{c} as {k}_{f}" for k, c in [('mean', 'round(avg(alive), 6)'), ('max', 'max(alive)::double'), ('min', 'min(alive)::double')] for f in LOG_FEATURES)},
  case when sum(alive) = 0 then -1 else cast(sum(alive) as bigint) end as n_seats
from (select s.contract_id, d.day, case when {label_sql('d.day', 's.create_day', 's.cancel_day', 30)} <> -1 then 1 else 0 end as alive
      from spans s cross join (select cast(unnest(range(30)) as int) as day) d)
group by contract_id, day"""),
)
def _(spark, sf):
    spans = event_spans(spark, sf)
    days = grid.dense_days(log_days(spark, sf), spans, LOG_FEATURES, EVENTS.horizon_days)
    masked = grid.mask_by_label(labels.with_day_label(days, EVENTS), LOG_FEATURES)
    df = pool.pool_presence(pool.attach_group_id(masked, spans), LOG_FEATURES)
    return rounded(df, [f"mean_{f}" for f in LOG_FEATURES])


@query("group_label", star("select contract_id, month, label from contract_label"))
def _(spark, sf):
    used = dates(spark, sf)
    spans = labels.join_seat_contract_labels(labels.seat_rollup(used), labels.contract_rollup(used))
    copies = labels.with_month_label(
        grid.dense_grid(
            spans.select("seat_id", "contract_id", F.col("contract_create_day").alias("create_day"), F.col("contract_cancel_day").alias("cancel_day")),
            STAR.n_months, "month",
        ),
        STAR,
    )
    return pool.group_label(copies)


@query("attach_group_id", star(f"select seat_id, month, contract_id, {', '.join(FEATURES)} from seat_month"))
def _(spark, sf):
    used = dates(spark, sf)
    rows = seat_month_usage(used, STAR).select("seat_id", "month", *FEATURES)
    return pool.attach_group_id(rows, labels.seat_rollup(used))


_TIME = " + ".join(STAR.time_features)
_COUNT = " + ".join(STAR.count_features)


@query("squeeze_features", star(f"select seat_id, month, cast({_TIME} as double) as total_time, cast({_COUNT} as double) as total_count from seat_month"))
def _(spark, sf):
    rows = pack_features(seat_month_usage(dates(spark, sf), STAR), FEATURES, dtype="double")
    pair = squeeze_array(F.col("f"), len(CATEGORIES))
    return rows.select("seat_id", "month", pair[0].alias("total_time"), pair[1].alias("total_count"))


@query(
    "concat_features",
    star(f"""select seat_id, month, cast({_TIME} as double) as x0, cast({_COUNT} as double) as x1,
  {', '.join(f'cast(life_{f} as double) as x{i + 2}' for i, f in enumerate(FEATURES))} from seat_month"""),
)
def _(spark, sf):
    rows = seat_month_usage(dates(spark, sf), STAR, lifetime=True)
    rows = pack_features(pack_features(rows, FEATURES, "f", "double"), LIFE, "g", "double")
    joined = F.concat(squeeze_array(F.col("f"), len(CATEGORIES)), F.col("g"))
    return rows.select("seat_id", "month", *[joined[i].alias(f"x{i}") for i in range(2 + len(FEATURES))])


@query("prep_tabular_baseline", _labelled(_sum_pool(FEATURES + LIFE), _shown(FEATURES + LIFE) + ", " + _COUNT_OR_MISSING))
def _(spark, sf):
    df = prep.prep_tabular_baseline(dates(spark, sf), STAR)
    return encoded(df, [*FEATURES, *LIFE, "n_seats"])


PREP_SEQUENCE_SQL = _labelled(_sum_pool(FEATURES), _shown(FEATURES) + ", " + _COUNT_OR_MISSING)


@query("prep_sequence_baseline", PREP_SEQUENCE_SQL)
def _(spark, sf):
    return encoded(prep.prep_sequence_baseline(dates(spark, sf), STAR), [*FEATURES, "n_seats"])


@query(
    "prep_seat_monthly",
    star(f"select seat_id, contract_id, month, label, {WEIGHT_SQL} as weight, {', '.join(f'case when label <> -1 then {f} else -1 end as {f}' for f in FEATURES)} from seat_month"),
)
def _(spark, sf):
    return encoded(prep.prep_seat_monthly(dates(spark, sf), STAR), FEATURES)


@query(
    "prep_seat_daily",
    star(f"""select s.seat_id, d.day, {label_sql('d.day', 's.create_day', 's.cancel_day', 365)} as label,
  {', '.join(f'case when u.seat_id is not null then u.{f} when d.day between s.create_day and s.cancel_day then 0 else -1 end as {f}' for f in FEATURES)}
from seats s cross join (select cast(unnest(range(365)) as int) as day) d
left join (select a.seat_id, a.day, {sums_sql()} from aged a group by a.seat_id, a.day) u on u.seat_id = s.seat_id and u.day = d.day"""),
)
def _(spark, sf):
    return encoded(prep.prep_seat_daily(dates(spark, sf), STAR), FEATURES)


_SQUEEZED = ["time", "count"]


@query(
    "prep_group_daily",
    star(f"""select p.contract_id, p.day, {', '.join(f"round(p.mean_alive, 6) as mean_{f}, p.max_alive as max_{f}, p.min_alive as min_{f}" for f in _SQUEEZED)},
  case when p.n = 0 then -1 else p.n end as n_seats,
  case when p.day % 30 = 0 then {label_sql('(p.day // 30)', 'cast(floor(c.create_day / 30.0) as int)', 'cast(floor(c.cancel_day / 30.0) as int)', 13)} else 0 end as label,
  case when p.day % 30 = 0 and {label_sql('(p.day // 30)', 'cast(floor(c.create_day / 30.0) as int)', 'cast(floor(c.cancel_day / 30.0) as int)', 13)} <> -1 then 1 else 0 end as weight
from (select contract_id, day, avg(alive) as mean_alive, max(alive)::double as max_alive, min(alive)::double as min_alive, cast(sum(alive) as bigint) as n
      from (select s.contract_id, d.day, case when {label_sql('d.day', 's.create_day', 's.cancel_day', 365)} <> -1 then 1 else 0 end as alive
            from seats s cross join (select cast(unnest(range(365)) as int) as day) d)
      group by contract_id, day) p join contracts c on c.contract_id = p.contract_id"""),
)
def _(spark, sf):
    df = prep.prep_group_daily(dates(spark, sf), _SQUEEZED, STAR)
    return rounded(df, [f"mean_{f}" for f in _SQUEEZED])
