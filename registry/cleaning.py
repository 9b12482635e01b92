"""Projections, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import FEATURES, assigned, cleaned, dates, encoded, query, star, text
from registry.sources import CLEAN_TEXT, _CLEAN_SQL
from seatwise.fixtures import STAR, star_assignment, star_taxonomy, star_usage, table
from seatwise.functions.dates import period_index
from seatwise.functions.vectors import decode_missing, encode_missing
from seatwise.operators import assign, clean
from seatwise.operators.months import seat_months
from seatwise.operators.usage import constant_column, global_min_date, with_day
from seatwise.sources.tables import union_all


def _day(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d') as {alias or column}"


@query("project_columns", star("select seat_id, member_id, contract_id from assignment"))
def _(spark, sf):
    raw = star_assignment(spark, sf)
    return clean.project_columns(raw, ["seat_id", "member_id", "contract_id"])


@query(
    "filter_unassigned",
    star(f"select seat_id, member_id, {_day('start_time')} from assignment where member_id <> 'GUID_IS_NULL_FOR_THE_ROW'"),
)
def _(spark, sf):
    df = clean.filter_unassigned(star_assignment(spark, sf), STAR.unassigned_member)
    return df.select("seat_id", "member_id", text("start_time"))


@query(
    "filter_end_before_cancel",
    star(f"""select seat_id, member_id, {_day('end_time')}, {_day('seat_cancelled_date')}
from assignment where cast(end_time as date) <= seat_cancelled_date"""),
)
def _(spark, sf):
    df = clean.filter_end_before_cancel(star_assignment(spark, sf))
    return df.select("seat_id", "member_id", text("end_time"), text("seat_cancelled_date"))


@query(
    "effective_create_date",
    star(f"""select seat_id, contract_id, {_day('start_time')},
  {_day('cast(greatest(seat_created_date, contract_created_date) as date)', 'create_date')} from assignment"""),
)
def _(spark, sf):
    df = clean.effective_create_date(star_assignment(spark, sf))
    return df.select("seat_id", "contract_id", text("start_time"), text("create_date"))


@query(
    "filter_date_range",
    star(f"""select member_id, {_day('event_time')}, product_name, session_time
from usage where cast(event_time as date) between date '1995-05-01' and date '1996-04-29'"""),
)
def _(spark, sf):
    df = clean.filter_date_range(star_usage(spark, sf), "event_time", STAR.event_from, STAR.event_to)
    return df.select("member_id", text("event_time"), "product_name", "session_time")


@query(
    "cast_dates",
    star(f"select seat_id, {_day('start_time')}, {_day('cast(contract_cancelled_date as date)', 'contract_cancelled_date')} from assignment"),
)
def _(spark, sf):
    df = clean.cast_dates(star_assignment(spark, sf), ["start_time", "contract_cancelled_date"])
    return df.select(
        "seat_id",
        F.col("start_time").cast("string").alias("start_time"),
        F.col("contract_cancelled_date").cast("string").alias("contract_cancelled_date"),
    )


@query("drop_columns", star("select member_id, contract_id, seat_id from assignment"))
def _(spark, sf):
    used = ["start_time", "end_time", *[c for c in clean.ASSIGNMENT_COLUMNS if c.endswith("_date")]]
    return clean.drop_columns(star_assignment(spark, sf), used)


@query(
    "normalize_product",
    star(f"""select u.member_id, {_day('u.event_time', 'event_time')}, coalesce(t.category, 'NA') as product_name, u.session_time
from usage u left join (select * from taxonomy where category <> 'rod') t on t.alias = u.product_name"""),
)
def _(spark, sf):
    # Without one category, so that some aliases are unknown.
    known = star_taxonomy(spark, sf).filter(F.col("category") != "rod")
    df = assign.normalize_product(star_usage(spark, sf), known, STAR.unknown_category)
    return df.select("member_id", text("event_time"), "product_name", "session_time")


@query(
    "filter_products",
    star(f"""select u.member_id, {_day('u.event_time', 'event_time')}, t.category as product_name, u.session_time
from usage u join taxonomy t on t.alias = u.product_name
where t.category in ('anvil','bolt','gear','gizmo','plate','ring','Rod','widget')"""),
)
def _(spark, sf):
    named = assign.normalize_product(star_usage(spark, sf), star_taxonomy(spark, sf), STAR.unknown_category)
    df = assign.filter_products(named, STAR.interest)
    return df.select("member_id", text("event_time"), "product_name", "session_time")


@query(
    "validate_interest",
    star("""select i.category from (values ('anvil'),('bolt'),('gear'),('gizmo'),('plate'),('ring'),('Rod'),('widget')) i(category)
where not exists (select 1 from taxonomy t where t.category = i.category)"""),
)
def _(spark, sf):
    return assign.validate_interest(star_taxonomy(spark, sf), STAR.interest)


@query("day_index", star("select seat_id, product_name, session_time, day from aged"))
def _(spark, sf):
    df = assigned(spark, sf)
    df = with_day(constant_column(df, global_min_date(df)))
    return df.select("seat_id", "product_name", "session_time", "day")


@query(
    "period_index",
    star("""select seat_id, cast(floor(create_day / 30.0) as int) as create_period,
  cast(floor(cancel_day / 30.0) as int) as cancel_period from seats"""),
)
def _(spark, sf):
    from seatwise.operators.labels import seat_rollup

    return seat_rollup(dates(spark, sf)).select(
        "seat_id",
        period_index(F.col("create_day"), STAR.period_days).alias("create_period"),
        period_index(F.col("cancel_day"), STAR.period_days).alias("cancel_period"),
    )


@query(
    "constant_column",
    star(f"""select c.seat_id, c.member_id, {_day('c.create_date', 'create_date')}, {_day('z.day_zero', 'day_zero')}
from cleaned c cross join (select min(create_date) as day_zero from cleaned) z"""),
)
def _(spark, sf):
    df = cleaned(spark, sf)
    df = constant_column(df, global_min_date(df))
    return df.select("seat_id", "member_id", text("create_date"), text("day_zero"))


@query(
    "encode_missing",
    star(f"""select seat_id, month, {', '.join(f'case when label <> -1 then {f} else -1 end as {f}' for f in FEATURES)}
from seat_month"""),
)
def _(spark, sf):
    df = seat_months(dates(spark, sf), STAR)
    return df.select("seat_id", "month", *[encode_missing(F.col(f), STAR.missing_value).cast("bigint").alias(f) for f in FEATURES])


@query(
    "decode_missing",
    star(f"""select seat_id, month, {', '.join(f'label <> -1 as has_{f}, coalesce(case when label <> -1 then {f} end, 0) as {f}' for f in FEATURES)}
from seat_month"""),
)
def _(spark, sf):
    codes = encoded(seat_months(dates(spark, sf), STAR), FEATURES)
    df = codes.withColumns({f: decode_missing(F.col(f), STAR.missing_value) for f in FEATURES})
    # NULL is told from 0 by a column of its own.
    shown = [c for f in FEATURES for c in (F.col(f).isNotNull().alias(f"has_{f}"), F.coalesce(f, F.lit(0)).cast("bigint").alias(f))]
    return df.select("seat_id", "month", *shown)


@query("dedup_rows", star(f"select distinct member_id, {_day('event_time')}, product_name, session_time from usage"))
def _(spark, sf):
    df = clean.dedup_rows(star_usage(spark, sf))
    return df.select("member_id", text("event_time"), "product_name", "session_time")


@query(
    "union_all",
    "select o_orderkey, o_custkey from orders where o_orderdate < timestamp '1996-01-01' "
    "union all select o_orderkey, o_custkey from orders where o_orderdate >= timestamp '1995-01-01'",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    columns = ["o_orderkey", "o_custkey"]
    early = orders.filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select(columns)
    late = orders.filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select(columns)
    return union_all(early, late)


@query("clean_assignments", star(_CLEAN_SQL))
def _(spark, sf):
    df = cleaned(spark, sf)
    return df.select("member_id", "contract_id", "seat_id", *[text(c) for c in CLEAN_TEXT])
