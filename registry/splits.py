"""Sampling and splits by contract."""

from __future__ import annotations

from registry.core import assigned, dates, query, star
from registry.sources import SPLIT_SQL, _SHARES, sample_days, samples_sql
from seatwise.fixtures import STAR
from seatwise.operators import split
from seatwise.operators.labels import seat_rollup
from seatwise.plans.prep import seat_samples

SIZES = {"train": 60, "valid": 20, "test": 20}
_EXACT_SQL = """select contract_id, case when r <= 60 then 'train' when r <= 80 then 'valid' else 'test' end as split
from (select contract_id, row_number() over (order by md5('churn:' || contract_id), contract_id) as r
      from (select distinct contract_id from assigned)) where r <= 100"""


def _exact(used):
    return split.group_split_exact(used, SIZES, "churn")


@query("group_split_exact", star(_EXACT_SQL))
def _(spark, sf):
    return _exact(assigned(spark, sf))


@query("group_split_fraction", star(SPLIT_SQL))
def _(spark, sf):
    return split.group_split_fraction(assigned(spark, sf), _SHARES, "churn")


@query(
    "semi_join_split",
    star(f"select s.seat_id, s.contract_id from seats s where s.contract_id in (select contract_id from ({_EXACT_SQL}) where split = 'train')"),
)
def _(spark, sf):
    used = dates(spark, sf)
    train = _exact(used).filter("split = 'train'")
    return split.semi_join_split(seat_rollup(used), train).select("seat_id", "contract_id")


@query("apply_split", samples_sql(_EXACT_SQL))
def _(spark, sf):
    used = dates(spark, sf)
    return sample_days(split.apply_split(seat_samples(used, STAR), _exact(used)))
