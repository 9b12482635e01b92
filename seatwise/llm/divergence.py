"""Divergence of sources by in-mapper stripes.

A task folds whole documents into a table of stripes: for each (language, term) the documents that have it and its
occurrences by source. A table that has grown to ``max_cells`` is spilled as rows and begun anew, so a task holds a bounded
part of the vocabulary, and a term in every document is one row for each spill. Stripes of a term meet in one place,
sorted, and are merged one after the other. Merged stripes with enough documents are the kept terms.

From a kept stripe follow directly the smoothed share of the term in each source and in the language, and so its part of
every divergence. Shares are whole numbers of 1e-9, so all sums are exact. Stripes are dealt into buckets of terms,
which add up what they have to say on each pair of sources; the buckets' sums are added in Spark. Only places where one of the
two sources has the term are visited; the others add a constant. Many sources are dealt into blocks too.

Results by case: NULL text, language or source counts as ''; a group without kept terms has pairs of value 0; a text
without terms counts for its group only; repeated rows count as documents of their own; equal values go by the item; an empty
table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from seatwise.llm.text import fold, texts_of
from seatwise.workspace import stage

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class DivergenceConfig:
    """A term is kept if ``min_docs`` documents of its language have it. ``top`` terms are listed for each group.
    ``max_cells`` bounds the stripes in a task, ``bucket_terms`` and ``block_sources`` what meets in a task later on."""

    min_docs: int = 3
    top: int = 200
    max_cells: int = 1_000_000
    bucket_terms: int = 20_000
    block_sources: int = 256


UNIT = 1_000_000_000
_STRIPE = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"
_NAMES = ["lang", "term", "docs", "sources", "counts"]


def _cells(key: np.ndarray, docs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of documents and occurrences by key, in the order of the keys."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(docs[order], first) if len(first) else docs, np.add.reduceat(n[order], first) if len(first) else n


def _stripes(lang: pa.Array, term: pa.Array, docs: np.ndarray, offsets: np.ndarray, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    cuts = pa.array(offsets, pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, sources), pa.ListArray.from_arrays(cuts, pa.array(counts, pa.int64()))]
    return pa.RecordBatch.from_arrays([lang, term, pa.array(docs, pa.int64()), *lists], _NAMES)


class Stripes:
    """Stripes of the documents folded so far: a number for each term and each (language, source), and a cell for each
    pair of them that occurs, sorted by key."""

    def __init__(self) -> None:
        self.terms: dict[str, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def fold(self, langs: list[str], sources: list[str], texts: list[str]) -> None:
        found = [TERM.findall(fold(t)) for t in texts]
        flat = [t for terms in found for t in terms]
        own = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.int64)
        if not flat:
            return
        codes, distinct = pd.factorize(np.array(flat, dtype=object))
        number = np.array([self.terms.setdefault(t, len(self.terms)) for t in distinct], np.int64)
        doc = np.repeat(np.arange(len(found)), [len(terms) for terms in found])
        place, n = np.unique(doc * len(distinct) + codes, return_counts=True)
        key = number[place % len(distinct)] << 32 | own[place // len(distinct)]
        self.parts.append(_cells(key, np.ones(len(key), np.int64), n))
        self.size += len(self.parts[-1][0])

    def fill(self) -> int:
        """Number of cells, after the parts have become one."""
        if len(self.parts) > 1:
            self.parts = [_cells(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))]
        self.size = sum(len(p[0]) for p in self.parts)
        return self.size

    def rows(self, most: int = 20_000) -> Iterator[pa.RecordBatch]:
        """All stripes, a row for each language and term."""
        if not self.fill():
            return
        key, docs, n = self.parts[0]
        langs = sorted({lang for lang, _ in self.groups})
        lang_of = np.array([langs.index(lang) for lang, _ in self.groups], np.int64)
        term, group = key >> 32, key & 0xFFFFFFFF
        order = np.lexsort((lang_of[group], term))
        term, group, docs, n = term[order], group[order], docs[order], n[order]
        lang = lang_of[group]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])]))
        ends = np.append(first, len(term))
        names, sources, lang_names = pa.array(self.terms, pa.string()), pa.array([s for _, s in self.groups], pa.string()), pa.array(langs, pa.string())
        in_stripe = np.add.reduceat(docs, first)
        for start in range(0, len(first), most):
            at, cuts = first[start : start + most], ends[start : start + most + 1]
            cells = slice(cuts[0], cuts[-1])
            yield _stripes(
                lang_names.take(pa.array(lang[at])), names.take(pa.array(term[at])), in_stripe[start : start + most], cuts - cuts[0], sources.take(pa.array(group[cells])), n[cells]
            )


def folded(docs: DataFrame, config: DivergenceConfig) -> DataFrame:
    """Stripes of the tasks; a term may have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stripes()
        for batch, texts in texts_of(batches):
            held.fold(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts)
            if held.size >= 2 * config.max_cells and held.fill() >= config.max_cells:
                yield from held.rows()
                held = Stripes()
        yield from held.rows()

    return docs.mapInArrow(run, _STRIPE)


def merged(stripes: DataFrame, config: DivergenceConfig) -> DataFrame:
    """One stripe for each kept term."""

    def of(table: pa.RecordBatch) -> pa.RecordBatch:
        """The stripes of each run of equal keys as one."""
        lang, term = table.column("lang"), table.column("term")
        change = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], change]))
        run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        sources = table.column("sources").flatten().dictionary_encode()
        cell_run = np.repeat(run_of, pc.list_value_length(table.column("sources")).to_numpy(zero_copy_only=False))
        names = sources.dictionary
        key, _, n = _cells(cell_run * max(len(names), 1) + sources.indices.to_numpy(), np.zeros(len(cell_run), np.int64), table.column("counts").flatten().to_numpy())
        cuts = np.searchsorted(key, np.arange(len(first) + 1) * max(len(names), 1))
        at = pa.array(first)
        return _stripes(lang.take(at), term.take(at), np.add.reduceat(table.column("docs").to_numpy(), first), cuts, names.take(pa.array(key % max(len(names), 1))), n)

    def kept(table: pa.RecordBatch) -> pa.RecordBatch:
        return table.filter(pc.greater_equal(table.column("docs"), config.min_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last run, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch.select(_NAMES).cast(held.schema)]).combine_chunks().to_batches()[0]
            done = of(batch)
            held = done.slice(done.num_rows - 1)
            yield kept(done.slice(0, done.num_rows - 1))
        if held is not None:
            yield kept(held)

    return stripes.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, _STRIPE)


def shares(counts: np.ndarray, totals: np.ndarray | int) -> np.ndarray:
    """1 + floor(1e9 * (count + 1) / total), by long division, so that nothing overflows."""
    rest, result = counts + 1, np.zeros(np.broadcast(counts, totals).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        result = result * 1000 + digit
    return result + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


@dataclass(frozen=True)
class Measure:
    """What a bucket of a language's stripes says on the sources of a block: sums over pairs and the bucket's top terms.

    ``groups`` has all sources of the language with their occurrences, those of the language and its number of terms.
    """

    top: int
    dense: int = 1_000_000

    def __call__(self, stripes: pa.Table, groups: pa.Table) -> pa.Table:
        if not stripes.num_rows or not groups.num_rows:
            return _results([])
        order = np.argsort(np.array(groups.column("source").to_pylist(), dtype=object), kind="stable")
        sources, block = ([groups.column(c).to_pylist()[i] for i in order] for c in ("source", "in_block"))
        totals = groups.column("n").to_numpy()[order] + groups.column("n_terms").to_numpy()[order]
        whole = groups.column("n_lang")[0].as_py() + groups.column("n_terms")[0].as_py()
        lang, mine, size = stripes.column("lang")[0].as_py(), np.flatnonzero(block), len(sources)
        place = {s: i for i, s in enumerate(sources)}
        terms = np.array(stripes.column("term").to_pylist(), dtype=object)
        names, values = stripes.column("sources").to_pylist(), stripes.column("counts").to_pylist()

        none = shares(np.zeros(size, np.int64), totals)
        apart = distance(none[mine][:, None], none)
        pairs = apart * len(terms)
        heads: list[tuple[int, np.ndarray, np.ndarray]] = []
        rows = max(1, self.dense // size)
        for start in range(0, len(terms), rows):
            part = range(start, min(start + rows, len(terms)))
            counts = np.zeros((len(part), size), np.int64)
            for row, k in enumerate(part):
                counts[row, [place[s] for s in names[k]]] = values[k]
            p = shares(counts, totals)
            lang_p = shares(counts.sum(axis=1), whole)
            for i, s in enumerate(mine):
                has = np.flatnonzero(counts[:, s])
                pairs[i] += (distance(p[has, s][:, None], p[has]) - apart[i]).sum(axis=0)
                more = has[p[has, s] > lang_p[has]]
                heads.append((s, more + start, distance(p[more, s], lang_p[more])))
            for t in range(size):
                has = np.flatnonzero(counts[:, t])
                lacks = counts[np.ix_(has, mine)] == 0
                pairs[:, t] += np.where(lacks, distance(none[mine], p[has, t][:, None]) - apart[:, t], 0).sum(axis=0)
        found = [(lang, sources[s], "pair", sources[t], int(pairs[i, t])) for i, s in enumerate(mine) for t in range(size) if s != t]
        for s in mine:
            at = np.concatenate([k for i, k, _ in heads if i == s])
            value = np.concatenate([v for i, _, v in heads if i == s])
            # All that reach the value of the last place: the exact order is found when the buckets meet.
            if len(value) > self.top:
                last = np.partition(value, -self.top)[-self.top]
                at, value = at[value >= last], value[value >= last]
            found += [(lang, sources[s], "term", terms[k], int(v)) for k, v in zip(at, value, strict=True)]
        return _results(found)


def _results(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = [pa.string()] * 4 + [pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source's divergence from each other source of its language
    (``pair``), and the terms that it uses more than its language (``term``), the largest values first."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    stripes = stage(merged(folded(texts, config), config), "stripes")
    cells = stripes.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("cell"))
    held = cells.groupBy("lang", F.col("cell.sources").alias("source")).agg(F.sum("cell.counts").alias("n"))
    n_terms = stripes.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    n_lang = held.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    zero = F.lit(0).cast("bigint")
    seen = texts.select("lang", "source").distinct()
    groups = seen.join(held, ["lang", "source"], "left").join(n_lang, "lang", "left").join(n_terms, "lang", "left")
    groups = stage(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "n_lang", "n_terms")]), "groups")

    # Buckets of terms and blocks of sources of each language.
    sizes = groups.groupBy("lang").agg(
        F.ceil(F.max("n_terms") / config.bucket_terms).cast("int").alias("buckets"), F.ceil(F.count(F.lit(1)) / config.block_sources).cast("int").alias("blocks")
    )
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")
    dealt = stripes.join(sizes, "lang").withColumn("bucket", bucket).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = groups.join(sizes.filter("buckets > 0"), "lang")
    every = every.withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    every = every.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = every.withColumn("in_block", F.col("own") == F.col("block"))
    every = every.toDF(*every.columns)  # own columns beside those of the other side
    keys, measure = ["lang", "bucket", "block"], Measure(config.top)
    found = dealt.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(
        lambda left, right: measure(left, right), "lang string, source string, part string, item string, value bigint"
    )
    found = stage(found, "divergence")

    # Pairs of languages without kept terms are in no bucket.
    other = groups.select("lang", F.col("source").alias("item"))
    bare = groups.filter("n_terms = 0").join(other, "lang").filter("source != item").select("lang", "source", F.lit("pair").alias("part"), "item", zero.alias("value"))
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.unionByName(bare).withColumn("rank", place)
    terms = found.filter("part = 'term'").withColumn("rank", place).filter(F.col("rank") <= config.top)
    return ranked.unionByName(terms)


# The same over the documents table; fixed values stand in for DivergenceConfig's defaults.
DIVERGENCE_SQL = """
with docs as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents),
found as (select lang, source, term, doc, count(*) as n from (select lang, source, doc, unnest(terms) as term from docs) group by all),
kept as (select lang, term, cast(sum(n) as hugeint) as n from found group by lang, term having count(*) >= 3),
counts as (select f.lang, f.source, f.term, cast(sum(f.n) as hugeint) as n from found f join kept k on k.lang = f.lang and k.term = f.term group by all),
vocabulary as (select lang, cast(count(*) as hugeint) as v, cast(sum(n) as hugeint) as n from kept group by lang),
groups as (
  select g.lang, g.source, coalesce(v.v, 0) as v, coalesce(c.n, 0) as n
  from (select distinct lang, source from docs) g left join vocabulary v on v.lang = g.lang
  left join (select lang, source, cast(sum(n) as hugeint) as n from counts group by all) c on c.lang = g.lang and c.source = g.source),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + g.v) as p,
    1 + (1000000000 * (k.n + 1)) // (v.n + v.v) as lang_p
  from groups g join kept k on k.lang = g.lang join vocabulary v on v.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
items as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(p.value, 0) as bigint) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, cast(((p - lang_p) * (p - lang_p)) // lang_p as bigint) from shares where n > 0 and p > lang_p)
select lang, source, part, item, value, cast(row_number() over w as integer) as rank from items
window w as (partition by lang, source, part order by value desc, encode(item))
qualify part = 'pair' or row_number() over w <= 200
"""
