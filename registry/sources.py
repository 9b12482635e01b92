"""Sources and sinks. Everything written goes to a fresh path in the shared folder and is read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from registry.core import FEATURES, WEIGHT_SQL, cleaned, dates, encoded, query, star, sums_sql, text, label_sql
from seatwise.fixtures import STAR, star_taxonomy, table
from seatwise.plans.prep import prep_seat_monthly, seat_samples
from seatwise.operators.split import split_of
from seatwise.sources import samples as sample_files, tables, taxonomy
from seatwise.workspace import new_path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark".split() + [
    "labels",
    "conversations",
]
MONTHS = [f"{1995 + (m + 4) // 12}-{(m + 4) % 12 + 1:02d}" for m in range(12)]


@query("scan_parquet", "select * replace (strftime(l_shipdate, '%Y-%m-%d') as l_shipdate) from lineitem")
def _(spark, sf):
    return tables.scan_parquet(spark, f"{sf}/lineitem.parquet").withColumn("l_shipdate", text("l_shipdate"))


@query(
    "scan_monthly_paths",
    "select o_orderkey, o_custkey from orders where strftime(o_orderdate, '%Y-%m') in ("
    + ", ".join(f"'{m}'" for m in MONTHS)
    + ")",
)
def _(spark, sf):
    base = new_path(spark, "monthly")
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")
    )
    orders.write.partitionBy("month").parquet(base)
    schema = "o_orderkey bigint, o_custkey bigint"
    return tables.scan_monthly_paths(spark, base, [f"month={m}" for m in MONTHS], schema)


@query("load_taxonomy", star("select alias, category from taxonomy"))
def _(spark, sf):
    path = new_path(spark, "taxonomy")
    taxonomy.write_taxonomy(star_taxonomy(spark, sf), path)
    return taxonomy.load_taxonomy(spark, path).select("alias", "category")


_CLEAN_SQL = """select member_id, contract_id, seat_id, strftime(start_time, '%Y-%m-%d') as start_time,
       strftime(end_time, '%Y-%m-%d') as end_time, strftime(seat_cancelled_date, '%Y-%m-%d') as seat_cancelled_date,
       strftime(contract_cancelled_date, '%Y-%m-%d') as contract_cancelled_date,
       strftime(create_date, '%Y-%m-%d') as create_date from cleaned"""
CLEAN_TEXT = ["start_time", "end_time", "seat_cancelled_date", "contract_cancelled_date", "create_date"]


@query("write_parquet_overwrite", star(_CLEAN_SQL))
def _(spark, sf):
    path = new_path(spark, "cleaned")
    raw = table(spark, sf, "customer").select(F.col("c_name").alias("old_content"))
    tables.write_parquet_overwrite(raw, path)
    tables.write_parquet_overwrite(cleaned(spark, sf), path)
    df = tables.scan_parquet(spark, path)
    return df.select("member_id", "contract_id", "seat_id", *[text(c) for c in CLEAN_TEXT])


@query(
    "list_input_files",
    " union all ".join(f"select '{t}.parquet' as file_name, count(*) as n_rows from {t}" for t in TABLES),
)
def _(spark, sf):
    listed = [tables.list_input_files(table(spark, sf, t)) for t in TABLES]
    files = reduce(lambda a, b: a.unionByName(b), listed)
    return files.select(F.element_at(F.split("file_path", "/"), -1).alias("file_name"), "n_rows")


@query(
    "export_tensor",
    star(f"""select s.seat_id, s.contract_id, a.day,
  {sums_sql()}, s.create_day as seat_create, s.cancel_day as seat_cancel,
  c.create_day as contract_create, c.cancel_day as contract_cancel
from seats s join contracts c on c.contract_id = s.contract_id join aged a on a.seat_id = s.seat_id
where a.day between 0 and 364
group by s.seat_id, s.contract_id, a.day, s.create_day, s.cancel_day, c.create_day, c.cancel_day"""),
)
def _(spark, sf):
    path = new_path(spark, "samples")
    sample_files.export_tensor(seat_samples(dates(spark, sf), STAR), path)
    df = sample_files.load_sample_columns(spark, path)
    cells = df.select(
        "seat_id", "contract_id", "seat_create", "seat_cancel", "contract_create", "contract_cancel",
        F.explode("x").alias("cell"),
    )
    return cells.select(
        "seat_id", "contract_id", "cell.day",
        *[F.col("cell.f")[i].alias(f) for i, f in enumerate(FEATURES)],
        "seat_create", "seat_cancel", "contract_create", "contract_cancel",
    )


_SHARES = {"train": 0.6, "valid": 0.2, "test": 0.2}
SPLIT_SQL = """select contract_id, case when h < 0.6 then 'train' when h < 0.8 then 'valid' else 'test' end as split
from (select contract_id, ('0x' || substring(md5('churn:' || contract_id), 1, 8))::bigint / 4294967296.0 as h
      from (select distinct contract_id from assigned))"""


def samples_sql(split: str) -> str:
    """Days of life or usage of all samples of a split, with their labels."""
    seat, contract = (label_sql("d.day", f"{t}.create_day", f"{t}.cancel_day", 365) for t in ("s", "c"))
    return star(f"""select p.split, s.contract_id, s.seat_id, d.day, {seat} as seat_label, {contract} as contract_label,
  {', '.join(f'coalesce(u.{f}, 0) as {f}' for f in FEATURES)}, s.create_day as seat_create, s.cancel_day as seat_cancel,
  c.create_day as contract_create, c.cancel_day as contract_cancel,
  greatest(0, least(floor(s.cancel_day / 30.0), 13) - floor(s.create_day / 30.0))::int as alive_seat_periods,
  greatest(0, least(floor(c.cancel_day / 30.0), 13) - floor(c.create_day / 30.0))::int as alive_contract_periods
from seats s join ({split}) p on p.contract_id = s.contract_id join contracts c on c.contract_id = s.contract_id
cross join (select cast(unnest(range(365)) as int) as day) d
left join (select a.seat_id, a.day, {sums_sql()} from aged a group by a.seat_id, a.day) u on u.seat_id = s.seat_id and u.day = d.day
where u.seat_id is not null or d.day between s.create_day and s.cancel_day""")


def sample_days(df):
    """Zero-filled samples as rows of days, with the labels of the day."""
    alive = lambda c: F.size(F.filter(c, lambda v: v == 0))
    rows = sample_files.fill_life(df, STAR).select("*", F.explode("x").alias("cell"))
    return rows.select(
        "split", "contract_id", "seat_id", "cell.day",
        F.get("label_seat_daily", F.col("cell.day")).alias("seat_label"),
        F.get("label_contract_daily", F.col("cell.day")).alias("contract_label"),
        *[F.col("cell.f")[i].alias(f) for i, f in enumerate(FEATURES)],
        "seat_create", "seat_cancel", "contract_create", "contract_cancel",
        alive("label_seat_monthly").alias("alive_seat_periods"), alive("label_contract_monthly").alias("alive_contract_periods"),
    )


@query("write_split_sets", samples_sql(SPLIT_SQL))
def _(spark, sf):
    path = new_path(spark, "splits")
    rows = seat_samples(dates(spark, sf), STAR)
    # The split follows from the contract id, so no membership table is joined.
    tables.write_split_sets(rows.withColumn("split", split_of(F.col("contract_id"), _SHARES, "churn")), path)
    parts = [
        tables.read_split_set(spark, path, split).withColumn("split", F.lit(split)) for split in _SHARES
    ]
    return sample_days(tables.union_all(*parts))


_DENSE = [f"case when u.seat_id is null then -1 else u.{f} end as {f}" for f in FEATURES]


@query(
    "dense_tensor",
    star(f"""select s.seat_id, d.day, {', '.join(_DENSE)}
from seats s cross join (select cast(unnest(range(365)) as int) as day) d
left join (select a.seat_id, a.day, {sums_sql()} from aged a group by a.seat_id, a.day) u on u.seat_id = s.seat_id and u.day = d.day"""),
)
def _(spark, sf):
    days = sample_files.dense_tensor(seat_samples(dates(spark, sf), STAR), STAR).select("seat_id", F.posexplode("x").alias("day", "f"))
    return days.select("seat_id", "day", *[F.col("f")[i].alias(f) for i, f in enumerate(FEATURES)])


@query(
    "load_sample_columns",
    star(f"""select s.seat_id, p.period,
  {label_sql('p.period', 'cast(floor(s.create_day / 30.0) as int)', 'cast(floor(s.cancel_day / 30.0) as int)', 13)} as label
from seats s cross join (select cast(unnest(range(13)) as int) as period) p"""),
)
def _(spark, sf):
    path = new_path(spark, "samples")
    sample_files.export_tensor(seat_samples(dates(spark, sf), STAR), path)
    df = sample_files.load_sample_columns(spark, path, ["seat_id", "label_seat_monthly"])
    return df.select("seat_id", F.posexplode("label_seat_monthly").alias("period", "label"))


@query(
    "save_load_intermediate",
    star(f"""select seat_id, contract_id, month, label, {WEIGHT_SQL} as weight,
  {', '.join(f'case when label <> -1 then {f} else -1 end as {f}' for f in FEATURES)}
from seat_month"""),
)
def _(spark, sf):
    path = new_path(spark, "seat_months")
    tables.save_intermediate(prep_seat_monthly(dates(spark, sf), STAR), path)
    columns = ["seat_id", "contract_id", "month", *FEATURES, "label", "weight"]
    return encoded(tables.load_intermediate(spark, path, columns), FEATURES)
