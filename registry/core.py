"""Registration, shared inputs and shared SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seatwise.config import ChurnConfig
from seatwise.fixtures import EVENTS, STAR, star_assignment, star_taxonomy, star_usage
from seatwise.functions.vectors import encode_missing
from seatwise.operators.clean import clean_assignments
from seatwise.plans.prep import assigned_from_raw, dated_usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same result on the same tables."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# ---- inputs -----------------------------------------------------------------------------------


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean_assignments(star_assignment(spark, sf), STAR)


def assigned(spark: SparkSession, sf: str, cfg: ChurnConfig = STAR) -> DataFrame:
    return assigned_from_raw(
        star_assignment(spark, sf), star_usage(spark, sf), star_taxonomy(spark, sf), cfg
    )


def dates(spark: SparkSession, sf: str) -> DataFrame:
    return dated_usage(assigned(spark, sf), STAR)


# ---- outputs ----------------------------------------------------------------------------------


def text(column: str) -> Column:
    """A date or timestamp as text, so that both engines print it alike."""
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def encoded(df: DataFrame, columns: Sequence[str], dtype: str = "bigint") -> DataFrame:
    """Missing values of the named columns as -1."""
    return df.withColumns(
        {c: encode_missing(F.col(c).cast("double")).cast(dtype) for c in columns}
    )


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Missing values as -1, the others rounded."""
    return df.withColumns(
        {c: F.round(encode_missing(F.col(c).cast("double")), digits) for c in columns}
    )


# ---- SQL --------------------------------------------------------------------------------------

FEATURES = STAR.features
CATEGORIES = STAR.categories


def _add(days: str) -> str:
    return f"cast(date '1995-05-01' + ({days}) as timestamp)"


STAR_TABLES = {
    "assignment": f"""
select case when c.c_custkey % 50 = 0 and k.k = 0 then 'GUID_IS_NULL_FOR_THE_ROW'
            else cast((c.c_custkey + k.k) % n.n as varchar(20)) end as member_id,
       concat(cast(c.c_nationkey as varchar(20)), '-', c.c_mktsegment) as contract_id,
       cast(c.c_custkey as varchar(20)) as seat_id,
       {_add("cast(c.c_custkey * 37 % 200 as int) + 90 * k.k")} as start_time,
       {_add('''case when k.k = 0 then cast(c.c_custkey * 37 % 200 as int) + 89
            else cast(c.c_custkey * 37 % 200 as int) + 90 + cast(c.c_custkey * 17 % 400 as int) end''')} as end_time,
       {_add("cast(c.c_custkey * 37 % 200 as int)")} as seat_created_date,
       {_add("cast(c.c_custkey * 37 % 200 as int) + 30 + cast(c.c_custkey * 53 % 600 as int)")} as seat_cancelled_date,
       {_add("cast(c.c_nationkey * 11 % 60 as int)")} as contract_created_date,
       {_add("250 + cast((c.c_nationkey * 97 + length(c.c_mktsegment) * 41) % 500 as int)")} as contract_cancelled_date
from customer c cross join (select 0 as k union all select 1 as k) k
     cross join (select count(*) as n from customer) n""",
    "usage": """
select cast(o.o_custkey as varchar(20)) as member_id, o.o_orderdate as event_time,
       p.p_name as product_name, cast(l.l_quantity as bigint) as session_time
from orders o join lineitem l on o.o_orderkey = l.l_orderkey join part p on p.p_partkey = l.l_partkey""",
    "taxonomy": """
select distinct p_name as alias, substring(p_name, position(' ' in p_name) + 1) as category from part""",
    "cleaned": """
select distinct member_id, contract_id, seat_id, start_time, end_time,
       cast(seat_cancelled_date as date) as seat_cancelled_date,
       cast(contract_cancelled_date as date) as contract_cancelled_date,
       cast(greatest(seat_created_date, contract_created_date) as date) as create_date
from assignment
where member_id <> 'GUID_IS_NULL_FOR_THE_ROW'
  and cast(end_time as date) <= seat_cancelled_date
  and cast(greatest(seat_created_date, contract_created_date) as date)
      between date '1995-05-01' and date '1996-05-29'""",
    "events_ok": """
select distinct u.member_id, u.event_time, t.category as product_name, u.session_time,
       cast(u.event_time as date) as event_date
from usage u join taxonomy t on t.alias = u.product_name
where cast(u.event_time as date) between date '1995-05-01' and date '1996-04-29'
  and t.category in ('anvil','bolt','gear','gizmo','plate','ring','Rod','widget')""",
    "assigned": """
select e.member_id, e.product_name, e.session_time, e.event_date, c.contract_id, c.seat_id,
       c.seat_cancelled_date, c.contract_cancelled_date, c.create_date
from events_ok e join cleaned c on e.member_id = c.member_id and e.event_date >= c.create_date
     and e.event_time >= c.start_time and e.event_time <= c.end_time""",
    "day0": "select min(create_date) as day_zero from assigned",
    "aged": "select a.*, cast(date_diff('day', z.day_zero, a.event_date) as int) as day from assigned a cross join day0 z",
    "seats": """
select seat_id, min(contract_id) as contract_id, cast(date_diff('day', z.day_zero, min(create_date)) as int) as create_day,
       cast(date_diff('day', z.day_zero, min(seat_cancelled_date)) as int) as cancel_day
from assigned cross join day0 z group by seat_id, z.day_zero""",
    "contracts": """
select contract_id, cast(date_diff('day', z.day_zero, min(create_date)) as int) as create_day,
       cast(date_diff('day', z.day_zero, min(contract_cancelled_date)) as int) as cancel_day
from assigned cross join day0 z group by contract_id, z.day_zero""",
}


def label_sql(step: str, created: str, cancelled: str, n: int) -> str:
    return (
        f"case when {cancelled} < {n} and {step} = {cancelled} then 1 "
        f"when {step} >= {created} and (coalesce({cancelled}, {n}) >= {n} or {step} < {cancelled}) then 0 "
        f"else -1 end"
    )


def month_label_sql(alias: str, month: str = "m.month") -> str:
    """Led monthly label of a row with ``create_day`` and ``cancel_day``."""
    return label_sql(
        f"({month} + 1)",
        f"cast(floor({alias}.create_day / 30.0) as int)",
        f"cast(floor({alias}.cancel_day / 30.0) as int)",
        13,
    )


def sums_sql(when: str = "true", features: bool = True, prefix: str = "") -> str:
    """Time and count sums per category over rows of ``aged``."""
    times = [
        f"cast(coalesce(sum(case when ({when}) and a.product_name = '{c}' then a.session_time end), 0) as bigint)"
        f" as {prefix}time_{c}"
        for c in CATEGORIES
    ]
    counts = [
        f"count(case when ({when}) and a.product_name = '{c}' then 1 end) as {prefix}count_{c}" for c in CATEGORIES
    ]
    return ",\n  ".join(times + counts)


STAR_TABLES |= {
    # Masked seat months, built day by day and month by month from the events.
    "seat_month": f"""
select s.seat_id, s.contract_id, m.month, {month_label_sql('s')} as label,
  {sums_sql('a.day between 30 * m.month and 30 * m.month + 28')},
  {sums_sql('a.day between 0 and 30 * m.month + 28', prefix='life_')}
from seats s cross join (select cast(unnest(range(12)) as int) as month) m left join aged a on a.seat_id = s.seat_id
group by s.seat_id, s.contract_id, s.create_day, s.cancel_day, m.month""",
    "contract_label": f"""
select c.contract_id, m.month, {month_label_sql('c')} as label
from contracts c cross join (select cast(unnest(range(12)) as int) as month) m""",
}


def _with(tables: dict[str, str], select: str) -> str:
    ctes = ",\n".join(f"{name} as ({body})" for name, body in tables.items())
    if select.startswith("with "):
        return f"with {ctes},\n{select.removeprefix('with ')}"
    return f"with {ctes}\n{select}"


def star(select: str) -> str:
    """A query over the star-schema churn tables; it may start with tables of its own."""
    return _with(STAR_TABLES, select)


EVENT_TABLES = {
    "spans": """
select distinct user_id as member_id, concat('S', cast(user_id as varchar(20))) as seat_id,
       user_id % 12 as contract_id, cast(user_id * 7 % 10 as int) as create_day,
       cast(user_id * 7 % 10 as int) + 5 + cast(user_id * 11 % 40 as int) as cancel_day
from events""",
    "usage": """
select user_id as member_id, ts as event_time, event_type as product_name,
       cast(round(value * 100) as bigint) as session_time,
       cast(date_diff('day', date '2024-01-01', cast(ts as date)) as int) as day
from events""",
    "joined": """
select u.member_id, u.product_name, u.session_time, u.day, s.seat_id, s.contract_id, s.create_day, s.cancel_day
from usage u join spans s on u.member_id = s.member_id and u.day between s.create_day and s.cancel_day""",
}


def log(select: str) -> str:
    """A query over the event-log churn tables."""
    return _with(EVENT_TABLES, select)


WEIGHT_SQL = "case label when 1 then 50.0::double when 0 then 1.0::double else 0.0::double end"
LOG_FEATURES = EVENTS.features
