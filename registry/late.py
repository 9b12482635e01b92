"""The event log with a day 0 three days late, so that seats exist before it, and with periods that end early; arrivals out of order."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from registry.core import FEATURES, LOG_FEATURES, STAR_TABLES, encoded, label_sql, log, query, rounded
from registry.pooling import PREP_SEQUENCE_SQL
from registry.usage import log_days
from seatwise.fixtures import DAY_ONE, EVENTS, STAR, event_spans, star_assignment, star_taxonomy, star_usage
from seatwise.operators import grid, labels, pool
from seatwise.streaming.upkeep import Upkeep, kept_features, run_batch
from seatwise.workspace import new_path

LATE = replace(EVENTS, day_zero=date(2024, 1, 4))
# 5 periods of 5 days end on day 25 of 30.
SHORT = replace(EVENTS, n_periods=5)
_LATE = "select seat_id, contract_id, create_day - 3 as create_day, cancel_day - 3 as cancel_day from spans"
_DAYS = "cross join (select cast(unnest(range(30)) as int) as day) d"


def late_spans(spark, sf):
    spans = event_spans(spark, sf)
    return spans.withColumns({c: F.col(c) - 3 for c in ("create_day", "cancel_day")})


@query(
    "presence_from_spans_late",
    log(f"""select contract_id, day, round(avg(alive), 6) as mean_alive, max(alive)::double as max_alive, min(alive)::double as min_alive,
  case when sum(alive) = 0 then -1 else cast(sum(alive) as bigint) end as n_seats
from (select s.contract_id, d.day, case when {label_sql('d.day', 's.create_day', 's.cancel_day', 30)} <> -1 then 1 else 0 end as alive
      from ({_LATE}) s {_DAYS})
group by contract_id, day"""),
)
def _(spark, sf):
    return rounded(pool.presence_from_spans(late_spans(spark, sf), ["alive"], LATE.horizon_days), ["mean_alive"])


@query(
    "zero_fill_life_late",
    log(f"""select s.seat_id, d.day, {', '.join(f"cast(coalesce(sum(case when j.product_name = '{c}' then j.session_time end), 0) as bigint) as time_{c}" for c in EVENTS.categories)},
  {', '.join(f"count(case when j.product_name = '{c}' then 1 end) as count_{c}" for c in EVENTS.categories)}
from ({_LATE}) s {_DAYS} left join joined j on j.seat_id = s.seat_id and j.day - 3 = d.day
where d.day between s.create_day and s.cancel_day group by s.seat_id, d.day"""),
)
def _(spark, sf):
    days = log_days(spark, sf).withColumn("day", F.col("day") - 3).filter("day >= 0")
    return grid.zero_fill_life(days, late_spans(spark, sf), LOG_FEATURES, LATE.horizon_days)


def _period_label(alias: str) -> str:
    return label_sql("p.period", f"cast(floor({alias}.create_day / 5.0) as int)", f"cast(floor({alias}.cancel_day / 5.0) as int)", 5)


@query(
    "expand_short_periods",
    log(f"""select s.seat_id, d.day, case when d.day % 5 = 0 then coalesce(l.label, 0) else 0 end as label,
  case when d.day % 5 = 0 and coalesce(l.label, -1) <> -1 then 1 else 0 end as weight
from ({_LATE}) s {_DAYS}
left join (select s.seat_id, p.period, {_period_label('s')} as label from ({_LATE}) s cross join (select cast(unnest(range(5)) as int) as period) p) l
  on l.seat_id = s.seat_id and l.period = d.day // 5"""),
)
def _(spark, sf):
    periods = labels.period_labels(late_spans(spark, sf).select("seat_id", "create_day", "cancel_day"), SHORT)
    return labels.expand_monthly_to_daily(periods, "seat_id", SHORT)


@query("kept_up_features", PREP_SEQUENCE_SQL.replace(STAR_TABLES["day0"], f"select date '{DAY_ONE}' as day_zero"))
def _(spark, sf):
    """Usage in two arrivals by member and month, the first under sessions that are partly wrong, missing or too many."""
    up = Upkeep(new_path(spark, "upkeep"), replace(STAR, day_zero=DAY_ONE), 8, share=1e-4, floor=20)
    usage, right, taxonomy = star_usage(spark, sf), star_assignment(spark, sf), star_taxonomy(spark, sf)
    key, later = F.col("seat_id").cast("bigint"), F.expr("interval 20 days")
    wrong = right.filter(key % 7 != 0).withColumns({
        "end_time": F.when(key % 5 == 0, F.col("end_time") - later).otherwise(F.col("end_time")),
        "contract_id": F.when(key % 11 == 0, F.concat(F.lit("old-"), "contract_id")).otherwise(F.col("contract_id")),
        "seat_cancelled_date": F.when(key % 3 == 0, F.col("seat_cancelled_date") + later).otherwise(F.col("seat_cancelled_date")),
    })
    arrival = F.pmod(F.xxhash64("member_id", F.date_format("event_time", "yyyy-MM")), F.lit(2))
    run_batch(spark, up, 0, usage.filter(arrival == 0), taxonomy, wrong)
    run_batch(spark, up, 1, usage.filter(arrival == 1), taxonomy, right)
    return encoded(kept_features(spark, up), [*FEATURES, "n_seats"])
