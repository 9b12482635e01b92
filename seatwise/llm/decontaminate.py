"""Benchmark decontamination by a distributed positional inverted index.

The index is divided by documents: a task takes chunks of documents and stores, for each term of a chunk, the ascending
positions where it stands. A frequent term is a list in each chunk, never one list of the corpus. For each window of
test words the lists of a chunk are intersected from the rarest term on, each shifted by its offset: what is left are exact
phrase matches. Proximity: the rarest terms of a test item stand near an occurrence of the rarest one.

Test items are a stated query set. It is taken in blocks of a bounded number of words; each block is sent to the tasks
and meets all chunks. Results of blocks are merged by document.

Results by case: NULL and empty texts have no words and no hits; items without words have no windows; items with the
same id are one item, a NULL id counts as ''; copies of a row each give a row; an empty table gives an empty one. Only the
id and text columns of both tables are read; ids may be NULL or repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from seatwise.llm.text import texts_of, words
from seatwise.workspace import stage


@dataclass(frozen=True)
class DecontaminationConfig:
    """``window`` words are a phrase. A near match has the ``rare_terms`` rarest terms of an item within ``near_span``
    words before or after the rarest. ``chunk_words`` and ``block_words`` bound what a task holds."""

    window: int = 10
    rare_terms: int = 4
    near_span: int = 30
    chunk_words: int = 2_000_000
    block_words: int = 2_000_000

    @property
    def gap(self) -> int:
        """Positions left free between documents, so that no match reaches over."""
        return max(self.window, self.near_span) + 1


def build_index(docs: DataFrame, config: DecontaminationConfig, terms: frozenset[str] | None = None) -> DataFrame:
    """Postings ``(chunk, term, positions)`` and, with a NULL term, one row ``(chunk, positions, n_words, doc_ids)`` of
    the chunk's documents and their starts. ``terms`` keeps postings of those terms only (None: all)."""
    wanted = docs.sparkSession.sparkContext.broadcast(terms)
    id_field = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        keep = wanted.value
        codes: dict[str, int] = {} if keep is None else {t: i for i, t in enumerate(sorted(keep))}
        missing = -1
        parts: list[np.ndarray] = []
        ids, starts, sizes = [], [], []
        at = 0

        def flushed(id_type: pa.DataType) -> pa.RecordBatch:
            found = np.concatenate([*parts, np.zeros((0, 2), np.int32)])
            found = found[found[:, 0] != missing]
            order = np.argsort(found[:, 0], kind="stable")
            code, position = found[order, 0], found[order, 1]
            cuts = np.flatnonzero(np.diff(code, prepend=-1))
            names = list(codes)
            present = [names[c] for c in code[cuts]]
            n = len(present) + 1
            offsets = np.concatenate([cuts, [len(code), len(code) + len(starts)]]).astype(np.int32)
            positions = np.concatenate([position, np.array(starts, np.int32)]).astype(np.int32)
            only_last = pa.array([None] * (n - 1) + [sizes], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * n, pa.int64()), pa.array([*present, None], pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(positions)),
                    only_last, pa.array([None] * (n - 1) + [ids], pa.list_(id_type)),
                ],
                ["chunk", "term", "positions", "n_words", "doc_ids"],
            )

        id_type = None
        for batch, texts in texts_of(batches):
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                found = words(text)
                if ids and at + len(found) > config.chunk_words:
                    yield flushed(id_type)
                    parts, ids, starts, sizes, at, chunk = [], [], [], [], 0, chunk + 1
                    if keep is None:
                        codes = {}
                code = [codes.setdefault(w, len(codes)) for w in found] if keep is None else [codes.get(w, missing) for w in found]
                parts.append(np.column_stack([np.array(code, np.int32), np.arange(at, at + len(found), dtype=np.int32)]))
                ids.append(doc_id)
                starts.append(at)
                sizes.append(len(found))
                at += len(found) + config.gap
        if ids:
            yield flushed(id_type)

    return docs.mapInArrow(run, f"chunk bigint, term string, positions array<int>, n_words array<int>, doc_ids array<{id_field}>")


@dataclass(frozen=True)
class TestBlock:
    """Windows with the numbers of the items that have them, and the rarest terms of each item."""

    items: list[str]
    windows: dict[tuple[str, ...], list[int]]
    rare: list[tuple[str, ...]]


def windows_of(text: str | None, window: int) -> set[tuple[str, ...]]:
    found = words(text)
    if not found:
        return set()
    return {tuple(found[i : i + window]) for i in range(max(1, len(found) - window + 1))}


def make_block(texts: dict[str, list[str]], frequency: dict[str, int], config: DecontaminationConfig) -> TestBlock:
    items, windows, rare = sorted(texts), {}, []
    for number, item in enumerate(items):
        for found in set().union(*[windows_of(t, config.window) for t in texts[item]]):
            windows.setdefault(found, []).append(number)
        terms = {w for t in texts[item] for w in words(t)}
        rare.append(tuple(sorted(terms, key=lambda w: (frequency.get(w, 0), w))[: config.rare_terms]))
    return TestBlock(items, windows, rare)


def phrase_starts(postings: dict[str, np.ndarray], phrase: tuple[str, ...]) -> np.ndarray:
    """Where the phrase stands: lists are intersected from the shortest on, each moved back by its offset."""
    lists = []
    for offset, term in enumerate(phrase):
        positions = postings.get(term)
        if positions is None:
            return np.zeros(0, np.int32)
        lists.append((len(positions), offset, positions))
    lists.sort(key=lambda x: x[:2])
    starts = lists[0][2] - lists[0][1]
    for _, offset, positions in lists[1:]:
        if not len(starts):
            break
        place = np.searchsorted(positions, starts + offset)
        starts = starts[positions[np.minimum(place, len(positions) - 1)] == starts + offset]
    return starts


def near_places(postings: dict[str, np.ndarray], terms: tuple[str, ...], span: int) -> np.ndarray:
    """Positions of the first term that have each of the others within ``span`` words."""
    if not terms or any(t not in postings for t in terms):
        return np.zeros(0, np.int32)
    places = postings[terms[0]]
    for term in terms[1:]:
        positions = postings[term]
        after = np.minimum(np.searchsorted(positions, places), len(positions) - 1)
        before = np.maximum(after - 1, 0)
        near = np.minimum(np.abs(positions[after] - places), np.abs(positions[before] - places))
        places = places[near <= span]
    return places


def search_chunk(table: pa.Table, block: TestBlock, config: DecontaminationConfig) -> dict[str, list]:
    """One chunk against one block: for each document the runs of hit words and the items found."""
    postings: dict[str, np.ndarray] = {}
    ids: list = []
    starts = sizes = np.zeros(0, np.int32)
    for batch in table.to_batches():
        positions = batch.column("positions")
        for i, term in enumerate(batch.column("term").to_pylist()):
            values = positions[i].values.to_numpy(zero_copy_only=False)
            if term is None:
                starts, sizes = values, np.array(batch.column("n_words")[i].as_py(), np.int32)
                ids = batch.column("doc_ids")[i].as_py()
            else:
                postings[term] = values
    length = int(starts[-1] + sizes[-1]) if len(starts) else 0
    change = np.zeros(length + 1, np.int32)
    exact: list[set[int]] = [set() for _ in ids]
    near: list[set[int]] = [set() for _ in ids]
    for phrase, numbers in block.windows.items():
        found = phrase_starts(postings, phrase)
        if len(found):
            np.add.at(change, found, 1)
            np.add.at(change, found + len(phrase), -1)
            for d in set((np.searchsorted(starts, found, "right") - 1).tolist()):
                exact[d].update(numbers)
    for number, terms in enumerate(block.rare):
        for d in set((np.searchsorted(starts, near_places(postings, terms, config.near_span), "right") - 1).tolist()):
            near[d].add(number)
    hit = np.cumsum(change[:-1]) > 0
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    firsts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(starts, firsts, "right") - 1
    runs: list[list[dict[str, int]]] = [[] for _ in ids]
    for d, a, b in zip(owner.tolist(), firsts.tolist(), ends.tolist(), strict=True):
        runs[d].append({"start": a - int(starts[d]), "end": b - int(starts[d])})
    named = lambda numbers: [block.items[i] for i in sorted(numbers)]
    return {
        "place": list(range(len(ids))), "doc_id": ids, "n_words": sizes.tolist(), "runs": runs,
        "items": [named(x) for x in exact], "near_items": [named(x) for x in near],
    }


def searcher(shared: Broadcast, config: DecontaminationConfig) -> Callable[[pa.Table], pa.Table]:
    """``search_chunk`` with the block that was sent to the tasks, as a function of one chunk's rows."""

    def search(table: pa.Table) -> pa.Table:
        found = search_chunk(table, shared.value, config)
        run = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        arrays = {
            "chunk": pa.array([table.column("chunk")[0].as_py()] * len(found["place"]), pa.int64()),
            "place": pa.array(found["place"], pa.int32()),
            "doc_id": pa.array(found["doc_id"], table.schema.field("doc_ids").type.value_type),
            "n_words": pa.array(found["n_words"], pa.int64()),
            "runs": pa.array(found["runs"], pa.list_(run)),
            "items": pa.array(found["items"], pa.list_(pa.string())),
            "near_items": pa.array(found["near_items"], pa.list_(pa.string())),
        }
        return pa.table(arrays)

    return search


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    config: DecontaminationConfig = DecontaminationConfig(),
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
) -> DataFrame:
    """``(doc_id, n_words, runs, items, near_items)``: runs are word intervals inside any exact match, apart and sorted."""
    spark = docs.sparkSession
    tests = benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    # A word takes a character and a separator at least, so this bounds the words.
    size = tests.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0] // 2
    n_blocks = max(1, -(-size // config.block_words))
    numbered = tests.withColumn("block", F.pmod(F.xxhash64("item"), n_blocks).cast("int"))

    read = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = read.schema["doc_id"].dataType.simpleString()
    fields = "runs array<struct<start:int,end:int>>, items array<string>, near_items array<string>"
    result, index = None, None
    for number in range(n_blocks):
        texts: dict[str, list[str]] = {}
        for row in numbered.filter(F.col("block") == number).select("item", "text").toLocalIterator():
            texts.setdefault(row["item"], []).append(row["text"])
        terms = frozenset(w for ts in texts.values() for t in ts for w in words(t))
        if index is None:
            # With one block the index holds the test terms; several blocks share one index of all terms.
            index = stage(build_index(read, config, terms if n_blocks == 1 else None), "postings")
        used = index
        if n_blocks > 1:
            listed = F.broadcast(spark.createDataFrame(sorted((t,) for t in terms), "term string"))  # bounded by the block
            used = index.join(listed, "term", "left_semi").unionByName(index.filter(F.col("term").isNull()))
        # One row for each term of the block.
        counts = used.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum(F.size("positions")).alias("n")).collect()
        block = make_block(texts, {r["term"]: r["n"] for r in counts}, config)
        shared = spark.sparkContext.broadcast(block)

        part = used.groupBy("chunk").applyInArrow(searcher(shared, config), f"chunk bigint, place int, doc_id {id_type}, n_words bigint, {fields}")
        result = part if result is None else result.unionByName(part)
    if n_blocks > 1:
        result = result.groupBy("chunk", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            merged_runs(F.array_sort(F.flatten(F.collect_list("runs")))).alias("runs"),
            F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("near_items")).alias("near_items"),
        )
    return result.select("doc_id", "n_words", "runs", "items", "near_items")


def merged_runs(runs):
    """Sorted intervals, those that meet or overlap made one."""
    kind = "array<struct<start:int,end:int>>"

    def step(kept, run):
        last = F.try_element_at(kept, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        return F.when(last.isNotNull() & (run["start"] <= last["end"]), F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(joined))).otherwise(
            F.concat(kept, F.array(run))
        )

    return F.aggregate(runs, F.array().cast(kind), step)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """The documents without any exact match, all columns kept.

    Whether a text has a match depends on the text alone, so texts are compared by digest: ids may be NULL or repeat.
    """
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    keyed = docs.select(F.struct("*").alias("row"), key.alias("key"), "text")
    found = contamination(keyed, benchmark, config, id_column="key").filter(F.size("runs") > 0)
    return keyed.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


# The same over the given tables, with the defaults of DecontaminationConfig as fixed values.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION_SQL = f"""
with docs as (select row_number() over () as rid, doc_id, {_WORDS} as ws from documents),
words as (select rid, unnest(ws) as w, unnest(range(len(ws))) as i from docs),
tests as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS} as ws from benchmark),
windows as (
  select distinct item, list_slice(ws, k, k + 9) as win
  from (select item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as k from tests where len(ws) > 0)),
tens as (select rid, i, list(w) over (partition by rid order by i rows between current row and 9 following) as win from words),
found as (
  select t.rid, t.i, len(w.win) as n, w.item
  from tens t cross join (select distinct len(win) as n from windows) l
  join windows w on len(w.win) = l.n and w.win = list_slice(t.win, 1, l.n)),
hits as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from found) group by rid),
items as (select rid, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as h from (select distinct rid, item from found) group by rid),
frequency as (select w, count(*) as n from words group by w),
rare as (
  select item, w, row_number() over (partition by item order by coalesce(n, 0), w) as r
  from (select distinct item, unnest(ws) as w from tests) left join frequency using (w)),
rarest as (select item, w, r, max(r) over (partition by item) as most from rare where r <= 4),
near as (
  select distinct rid, item from (
    select a.rid, a.i, t.item, t.most, count(distinct u.r) as others
    from words a join rarest t on t.w = a.w and t.r = 1
    left join rarest u on u.item = t.item and u.r > 1
      and exists (select 1 from words b where b.rid = a.rid and b.w = u.w and b.i between a.i - 30 and a.i + 30)
    group by a.rid, a.i, t.item, t.most)
  where others = most - 1)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
  coalesce(i.h, sha256('')) as items_sha256, h.n_hit is not null as contaminated,
  (select count(*) from near x where x.rid = d.rid) as n_near_items
from docs d left join hits h on h.rid = d.rid left join items i on i.rid = d.rid
"""
