"""Near duplicates by ProbMinHash of weighted word shingles, banding and verification.

Shingles are five consecutive words (all words of a shorter text), weighted by 1 + ln(count). An element's arrivals form
a Poisson process whose rate is its weight; each arrival falls on one register, and the element that comes first to a
register signs it. Generation stops for an element once its next arrival is later than all registers, so it costs about
one arrival for each element. Two texts agree on a register with the probability Jaccard of their weights.

Texts that agree on a whole band meet in a bucket. Work is on distinct texts. A bucket is cut into blocks of a bounded
size. In a block, pairs of different classes are verified exactly, likeliest first, and each pair that reaches
the threshold merges two classes; pairs inside a class are skipped. So no more links are made than there are texts.
Buckets are taken in rounds, and only those that still hold several classes go on. Buckets that were cut are finished
in the last round, where the texts outside a bucket's largest class meet those of its other blocks.

A pair that shares several buckets is verified in that of its first common band only: there it meets in a block or in
the last round. Which texts have such a pair is seen from the signatures, and only their shingles, hashed once for each
text, go to the blocks. With w and v the weights of two texts, M the sum of max(w, v) over all elements, the
probability Jaccard is between the sums of min(w, v) / M and of max(w, v) / M over the common elements; the two are equal
if common elements weigh the same. Many pairs get these bounds at once, and those they do not decide the exact sum.

Misses: 80 registers in 20 bands of 4 miss a pair at 0.8 with probability 2.6e-5; pairs that agree on less than 55 % of
the registers are not verified, which at 0.8 leaves out 1e-7 (binomial) and falls fast above.

Results by case: texts without words (NULL, empty, separators only) are classes of their own, each row apart; copies and
repeated rows share a class; a NULL id counts for a class only if all its ids are NULL; an empty table gives an empty
one. Only the id and text columns are read, but ``without_near_duplicates`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seatwise.llm.text import texts_of
from seatwise.operators.skew import skew_join
from seatwise.workspace import in_few, stage

# A class or text with more rows than this, and than 1/2000 of all, is split over tasks.
HOT_ROWS = 300
# Rows of a task that writes a stage: of keys and classes, and of whole texts.
KEY_ROWS, TEXT_ROWS = 100_000, 5_000
# Pairs whose signatures, and shingles whose weights, are compared at once.
PAIRS, WEIGHTS = 10_000, 400_000
# Bounds this near the threshold do not decide.
ROUNDING = 1e-9


@dataclass(frozen=True)
class NearDupConfig:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 4
    first_bands: int = 4
    least_agreement: float = 0.55
    block: int = 400
    # Of the last round: texts of a block, and bytes of their shingles.
    late_block: int = 2_000
    late_bytes: int = 16_000_000
    batch_words: int = 400_000

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


# Of each byte of UTF-8: whether it belongs to a word, as in ``text.words``, and the byte with A-Z made a-z.
_IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_FOLDED = np.array([ord(chr(b).lower()) if b < 0x80 else b for b in range(256)], np.uint8)
# Of a number that holds 8 bytes, those that are left of the end of a word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts (UTF-8), and the number of words of each text."""
    raw = np.frombuffer(b" ".join([*texts, b" " * 8]), np.uint8)
    folded = _FOLDED[raw]
    inside = _IN_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    start, end = edges[::2], edges[1::2]
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    lengths = np.diff(np.searchsorted(start, ends), prepend=0)
    eight = np.ndarray(len(folded) - 7, "<u8", folded, strides=(1,))  # at each place the 8 bytes from there
    left = end - start
    value = mixed(left.astype(np.uint64) + _STEP)
    value = mixed(value + (eight[start] & _FIRST[np.minimum(left, 8)]))
    going = np.flatnonzero(left > 8)
    turn = 0
    while len(going):
        turn += 8
        value[going] = mixed(value[going] + (eight[start[going] + turn] & _FIRST[np.minimum(left[going] - turn, 8)]))
        going = going[left[going] > turn + 8]
    return value, lengths


def text_shingles(texts: Sequence[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of all texts: number of the text and 64-bit hash. Texts of 1 to size - 1 words have one shingle."""
    word, lengths = word_hashes(texts)
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(word))  # words from here to the end of the text
    first = left == np.repeat(lengths, lengths)
    starts = np.flatnonzero((left >= size) | (first & (left < size)))
    left = left[starts]
    value = np.zeros(len(starts), np.uint64)
    word = np.concatenate([word, np.zeros(size, np.uint64)])
    for i in range(size):
        value = np.where(left > i, mixed(value * _STEP + word[starts + i]), value)
    return owner[starts], value


def shingle_hashes(texts: Sequence[list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """``text_shingles`` of texts that are lists of words."""
    return text_shingles([" ".join(t).encode() for t in texts], size)


def weighted(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, with their weights."""
    if not len(value):
        return owner, value, np.zeros(0)
    order = np.argsort(value)
    # Few texts are sorted by counting.
    place = owner[order].astype(np.uint16) if owner.max() < 2**16 else owner[order]
    order = order[np.argsort(place, kind="stable")]
    owner, value = owner[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]))
    counts = np.diff(np.concatenate([first, [len(value)]]))
    return owner[first], value[first], 1 + np.log(counts)


def prob_minhash(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Signatures of ``n`` texts: for each register 32 bits of the element that arrives first; 0 without elements."""
    soonest = np.full(n * registers, np.inf)
    signed = np.zeros(n * registers, np.uint32)
    arrival = np.zeros(len(value))
    turn = 0
    while len(value):
        turn += 1
        draw = mixed(value + np.uint64(turn * int(_STEP) % 2**64))
        arrival = arrival - np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / weight
        place = owner * registers + (mixed(draw ^ _STEP) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(soonest, place, arrival)
        won = arrival == soonest[place]
        signed[place[won]] = (value[won] >> np.uint64(32)).astype(np.uint32)
        # Of the texts that still have elements; these are sorted by text.
        some = np.flatnonzero(np.diff(owner, prepend=-1))
        latest = soonest.reshape(n, registers)[owner[some]].max(axis=1)
        going = arrival < np.repeat(latest, np.diff(some, append=len(owner)))
        owner, value, weight, arrival = owner[going], value[going], weight[going], arrival[going]
    return signed.reshape(n, registers)


def probability_jaccard(a: np.ndarray, a_weight: np.ndarray, b: np.ndarray, b_weight: np.ndarray) -> float:
    """Sum over common elements i of 1 / sum over j of max(p_j / p_i, q_j / q_i); ``a`` and ``b`` sorted, distinct."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    p, q = a_weight / a_weight.sum(), b_weight / b_weight.sum()
    p_common, q_common = p[i], q[j]
    order = np.argsort(-p_common / q_common, kind="stable")
    p_common, q_common = p_common[order], q_common[order]
    p_above = 1 - p_common.sum() + np.cumsum(p_common)
    q_below = 1 - np.cumsum(q_common)
    return float((1 / (p_above / p_common + q_below / q_common)).sum())


def slices(texts: list[str], most: int) -> Iterator[list[bytes]]:
    """The texts in groups of about ``most`` words (or one longer text), a word with what ends it taken for four bytes."""
    held: list[bytes] = []
    n = 0
    for text in texts:
        coded = text.encode()
        if held and n + len(coded) // 4 + 1 > most:
            yield held
            held, n = [], 0
        held.append(coded)
        n += len(coded) // 4 + 1
    if held:
        yield held


def signatures(docs: DataFrame, config: NearDupConfig) -> DataFrame:
    """``(key, doc_id, signature)`` for ``(key, doc_id, text)``; NULL without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            found: list[bytes | None] = []
            for group in slices(texts, config.batch_words):
                owner, value, weight = weighted(*text_shingles(group, config.shingle))
                signs = prob_minhash(owner, value, weight, len(group), config.registers)
                some = np.bincount(owner, minlength=len(group)) > 0
                found += [s.tobytes() if t else None for s, t in zip(signs, some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), pa.array(found, pa.binary())], ["key", "doc_id", "signature"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("key", "doc_id", "text").mapInArrow(run, f"key string, doc_id {id_type}, signature binary")


def shingled(texts: DataFrame, config: NearDupConfig) -> DataFrame:
    """``(key, signature, value, heavy, weight)`` for ``(key, signature, text)``: the sorted shingles of a text, and the places
    and weights of those that weigh more than 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            values: list[bytes] = []
            places: list[bytes] = []
            weights: list[bytes] = []
            for group in slices(texts, config.batch_words):
                owner, value, weight = weighted(*text_shingles(group, config.shingle))
                cuts = np.searchsorted(owner, np.arange(len(group) + 1))
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    heavy = np.flatnonzero(weight[x:y] > 1)
                    values.append(value[x:y].tobytes())
                    places.append(heavy.astype(np.uint32).tobytes())
                    weights.append(weight[x:y][heavy].tobytes())
            found = [pa.array(x, pa.binary()) for x in (values, places, weights)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("signature"), *found], ["key", "signature", "value", "heavy", "weight"]
            )

    return texts.select("key", "signature", "text").mapInArrow(
        run, "key string, signature binary, value binary, heavy binary, weight binary"
    )


def _numbers(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binary arrays, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize


def read_shingles(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and weights of all rows of ``shingled``, and where each row begins."""
    value, sizes = _numbers(table.column("value"), np.uint64)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    places, heavy = _numbers(table.column("heavy"), np.uint32)
    weight = np.ones(len(value))
    weight[places + np.repeat(cuts[:-1], heavy)] = _numbers(table.column("weight"), np.float64)[0]
    return value, weight, cuts


def pairs_within(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with all rows after it and before its end, a bounded number of pairs at a time (or those of one row)."""
    after = ends - np.arange(len(ends)) - 1
    total = np.cumsum(after)
    first = 0
    while first < len(ends):
        done = total[first] - after[first]
        last = max(first + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        n = after[first:last]
        i = np.repeat(np.arange(first, last), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        first = last


def agreeing(
    signs: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray, config: NearDupConfig
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs ``(i, j)`` in buckets of ``band`` those that agree on enough registers and on no earlier band, with the
    share of registers."""
    same = signs[i] == signs[j]
    agreement = np.count_nonzero(same, axis=1) / config.registers
    near = np.flatnonzero(agreement >= config.least_agreement)
    shared = np.logical_and.reduce([same[near, k :: config.rows] for k in range(config.rows)])
    near = near[shared.argmax(axis=1) == band[i[near]]]
    return i[near], j[near], agreement[near]


def candidates(blocks: DataFrame, config: NearDupConfig) -> DataFrame:
    """Those ``(bucket, block, band, key, class, signature)`` that are in a pair to be verified in their block, without signature."""

    def found(table: pa.Table) -> list[pa.RecordBatch]:
        table = table.combine_chunks()
        bucket, block, band = (table.column(c).to_numpy() for c in ("bucket", "block", "band"))
        signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(bucket), config.registers)
        member = table.column("class").combine_chunks().dictionary_encode().indices.to_numpy()
        ends = np.append(_changes(bucket, block), len(bucket))
        ends = np.repeat(ends, np.diff(ends, prepend=0))
        wanted = np.zeros(len(bucket), bool)
        for i, j in pairs_within(ends):
            apart = member[i] != member[j]
            i, j, _ = agreeing(signs, band, i[apart], j[apart], config)
            wanted[i] = wanted[j] = True
        return table.drop_columns(["signature"]).filter(pa.array(wanted)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            # The last block may go on in the next batch.
            starts = _changes(table.column("bucket").to_numpy(), table.column("block").to_numpy())
            last = int(starts[-1]) if len(starts) else 0
            if last:
                yield from found(table.slice(0, last))
            held = table.slice(last).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    columns = ["bucket", "block", "band", "key", "class"]
    dealt = blocks.select(*columns, "signature").repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(run, "bucket long, block int, band int, key string, class string")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Rows, the first apart, that differ from the one before."""
    return np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1


def bounds(
    codes: np.ndarray, weight: np.ndarray, cuts: np.ndarray, n_codes: int, i: np.ndarray, j: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the probability Jaccard of the pairs ``(i, j)``. ``codes``: numbers below ``n_codes`` of the
    shingles, those of text k from ``cuts[k]`` on."""
    sizes = np.diff(cuts)
    sums = np.add.reduceat(weight, cuts[:-1])
    low, high = np.zeros(len(i)), np.zeros(len(i))
    here = np.zeros(n_codes)
    order = np.argsort(i, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        text = slice(cuts[i[own[0]]], cuts[i[own[0]] + 1])
        here[codes[text]] = weight[text]
        read = np.cumsum(sizes[j[own]]) // WEIGHTS
        for some in np.split(own, np.flatnonzero(np.diff(read)) + 1):
            n = sizes[j[some]]
            starts = np.cumsum(n) - n
            place = np.arange(int(n.sum())) + np.repeat(cuts[j[some]] - starts, n)
            a, b = here[codes[place]], weight[place]
            low[some] = np.add.reduceat(np.minimum(a, b), starts)
            high[some] = np.add.reduceat(np.where(a > 0, np.maximum(a, b), 0), starts)
        here[codes[text]] = 0
    every = sums[i] + sums[j] - low
    return low / every, high / every


def merger(config: NearDupConfig, late: bool = False) -> Callable[[pa.Table], pa.Table]:
    """One block of texts: pairs of classes that merge, as (class, smallest class of those merged).

    ``late``: the last round, where texts outside the largest class, ``guest`` here, meet the others, but not those of the
    same ``met``, which they have met before. Two texts outside meet where that of the smaller class is the guest.
    """

    def near(table: pa.Table, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs to verify, likeliest first."""
        signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(member), config.registers)
        band = table.column("band").to_numpy()
        if late:
            guest, outside, met = (table.column(c).to_numpy() for c in ("guest", "outside", "met"))
            hosts = np.flatnonzero(~guest)
            step = max(1, PAIRS // max(1, len(hosts)))
            guests = np.flatnonzero(guest)
            every = ((np.repeat(g, len(hosts)), np.tile(hosts, len(g))) for g in (guests[k : k + step] for k in range(0, len(guests), step)))
        else:
            every = pairs_within(np.full(len(member), len(member)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, j in every:
            apart = member[i] != member[j]
            if late:
                apart &= (met[i] != met[j]) & (~outside[j] | (member[i] < member[j]))
            found.append(agreeing(signs, band, i[apart], j[apart], config))
        i, j, agreement = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(-agreement, kind="stable")
        return i[order], j[order]

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        labels, member = np.unique(np.array(table.column("class").to_pylist(), dtype=object), return_inverse=True)
        root = list(range(len(labels)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        i, j = near(table, member) if len(labels) > 1 else ([], [])
        if len(i):
            value, weight, cuts = read_shingles(table)
            distinct, codes = np.unique(value, return_inverse=True)
            # The first pairs merge most classes, so that pairs after them need no look.
            first, n = 0, len(member)
            while first < len(i):
                x, y = i[first : first + n], j[first : first + n]
                first, n = first + n, 2 * n
                roots = np.array([find(k) for k in range(len(labels))])
                apart = roots[member[x]] != roots[member[y]]
                x, y = x[apart], y[apart]
                if not len(x):
                    continue
                low, high = bounds(codes, weight, cuts, len(distinct), x, y)
                for k in np.flatnonzero(high >= config.threshold - ROUNDING).tolist():
                    a, b = find(int(member[x[k]])), find(int(member[y[k]]))
                    if a == b:
                        continue
                    p, q = slice(cuts[x[k]], cuts[x[k] + 1]), slice(cuts[y[k]], cuts[y[k] + 1])
                    if low[k] >= config.threshold + ROUNDING or probability_jaccard(value[p], weight[p], value[q], weight[q]) >= config.threshold:
                        root[max(a, b)] = min(a, b)
        merged = [(labels[k], labels[find(k)]) for k in range(len(labels)) if find(k) != k]
        return pa.table({"u": pa.array([m[0] for m in merged], pa.string()), "v": pa.array([m[1] for m in merged], pa.string())})

    return merge


def components(links: DataFrame, name: str = "star", most: int | None = None) -> DataFrame:
    """``(node, root)`` of each node in the undirected ``links (u, v)``; the root is the smallest node. ``most``: a bound of
    the number of links, if one is known.

    Large stars then small stars, until each node but the roots has one edge, to a root. A root with very many nodes is
    a hot key on one side of a join with one row for each key, and minima are taken in the tasks first.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    edges = stage(edges if most is None else in_few(edges, most, KEY_ROWS), name)
    before = None
    while (mark := _mark(edges)) != before and mark[0]:
        before = mark
        # Large star: what is larger than u goes to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(in_few(large, mark[0], KEY_ROWS), name)
        # Small star: u and its smaller neighbours go to the smallest of them.
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(in_few(edges, 2 * mark[0], KEY_ROWS), name)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def with_classes(members: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Add ``class``: the class that the key is in by now, at first the key itself."""
    if classes is None:
        return members.withColumn("class", F.col("key"))
    return members.join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))


def relabelled(classes: DataFrame | None, merged: DataFrame, most: int) -> DataFrame:
    """``(key, class)`` after classes have merged into roots; keys that are classes of their own have no row. ``most``: a bound
    of the number of keys."""
    new = merged.select(F.col("node").alias("key"), F.col("root").alias("class"))
    if classes is None:
        return stage(in_few(new, most, KEY_ROWS), "classes")
    moved = classes.join(merged, F.col("class") == F.col("node"), "left").select("key", F.coalesce("root", "class").alias("class"))
    return stage(in_few(moved.unionByName(new.join(classes.select("key"), "key", "left_anti")), most, KEY_ROWS), "classes")


def met_in(config: NearDupConfig) -> Column:
    """The block of a member in a bucket of ``n``."""
    return F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / F.lit(config.block)).cast("int")).cast("int")


def text_classes(rows: DataFrame, docs: DataFrame, config: NearDupConfig, n_rows: int) -> DataFrame | None:
    """``(key, class)`` of the texts that are in a class with other texts; None if there are none.

    ``rows`` is the staged output of ``signatures``, ``n_rows`` their number; ``docs`` has the texts, of which only those in
    buckets are read.
    """
    nodes = rows.filter(F.col("signature").isNotNull()).groupBy("key").agg(F.first("signature").alias("signature"))
    width = 4 * config.rows
    band = F.transform(
        F.sequence(F.lit(0), F.lit(config.bands - 1)),
        lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring(F.col("signature"), b * width + 1, F.lit(width))).alias("bucket")),
    )
    placed = nodes.select("key", F.inline(band))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(in_few(placed.join(shared, "bucket"), n_rows * config.bands, KEY_ROWS), "members")
    wanted = members.select("key").distinct()
    texts = docs.select("key", "text").join(wanted, "key").groupBy("key").agg(F.first("text").alias("text"))
    texts = stage(shingled(in_few(texts.join(nodes, "key"), n_rows, TEXT_ROWS), config), "texts")
    most = members.count()

    classes = None
    for part in (F.col("band") < config.first_bands, F.col("band") >= config.first_bands):
        found = with_classes(members.filter(part), classes)
        mixed_up = found.groupBy("bucket").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a != b").select("bucket")
        cut = met_in(config)
        blocks = found.join(mixed_up, "bucket").withColumn("block", cut).join(texts.select("key", "signature"), "key")
        classes = merged_blocks(candidates(blocks, config).withColumn("part", F.lit(0)), texts, classes, merger(config), most)

    # Buckets that were cut and still hold several classes: what is outside the largest class meets what was in other blocks.
    cut = members.filter(F.col("n") > config.block)
    if cut.isEmpty():
        return classes
    large = stage(with_classes(cut, classes).join(texts.select("key", F.octet_length("value").alias("bytes")), "key"), "large")
    sizes = large.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("bytes"))
    order = F.struct("c", "class")
    main = sizes.groupBy("bucket").agg(
        F.max_by("class", order).alias("main"), F.max("c").alias("most"), F.max_by("bytes", order).alias("main_bytes"), F.sum("c").alias("all"), F.sum("bytes").alias("all_bytes")
    ).filter("all > most")
    in_blocks = lambda n, size: F.ceil(F.greatest(n / config.late_block, size / config.late_bytes)).cast("int")
    main = main.select(
        "bucket", "main", in_blocks(F.col("all"), F.col("all_bytes")).alias("blocks"), in_blocks(F.col("all") - F.col("most"), F.col("all_bytes") - F.col("main_bytes")).alias("parts")
    )
    here = large.join(main, "bucket").withColumn("met", met_in(config)).withColumn("outside", F.col("class") != F.col("main"))
    block = F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int")
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int")
    every = here.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    guests = here.filter("outside").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["bucket", "block", "part", "band", "key", "class", "met", "outside"]
    pairs = every.select(*columns, F.lit(False).alias("guest")).unionByName(guests.select(*columns, F.lit(True).alias("guest")))
    return merged_blocks(pairs, texts, classes, merger(config, late=True), most)


def merged_blocks(
    blocks: DataFrame, texts: DataFrame, classes: DataFrame | None, merge: Callable[[pa.Table], pa.Table], most: int
) -> DataFrame | None:
    """The classes after the pairs inside the blocks have merged. ``most``: the number of members, which bounds links and keys."""
    links = blocks.join(texts, "key").groupBy("bucket", "block", "part").applyInArrow(merge, "u string, v string")
    merged = components(links, most=most)
    return classes if merged.isEmpty() else relabelled(classes, merged, most)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(text_key(F.col(text_column)).alias("key"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def labelled(docs: DataFrame, id_column: str, text_column: str, config: NearDupConfig) -> DataFrame:
    """``(key, doc_id, alone, class)`` for each row; ``alone`` marks rows without words."""
    keyed = _keyed(docs, id_column, text_column)
    rows = stage(signatures(keyed, config), "signatures")
    n_rows = rows.count()
    classes = text_classes(rows, keyed, config, n_rows)
    found = rows.select("key", "doc_id", F.col("signature").isNull().alias("alone"))
    if classes is None:
        return with_classes(found, None)
    # A text with very many copies is a hot key.
    joined = skew_join(found, classes, ["key"], ["doc_id"], "left", floor=HOT_ROWS).withColumn("class", F.coalesce("class", "key"))
    return in_few(joined, n_rows, KEY_ROWS)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", config: NearDupConfig = NearDupConfig()
) -> DataFrame:
    """``(doc_id, class_id)`` for each row: the smallest id of the documents that are linked to it, directly or not."""
    found = stage(labelled(docs, id_column, text_column, config), "labelled")
    least = found.filter("not alone").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = skew_join(found, least.select("class", "class_id"), ["class"], ["doc_id", "key"], "left", floor=HOT_ROWS)
    return shared.select("doc_id", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"))


def without_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", config: NearDupConfig = NearDupConfig()
) -> DataFrame:
    """The documents with one row of each class, that of the smallest id (then text digest); all columns kept."""
    found = stage(labelled(docs, id_column, text_column, config).filter("not alone"), "labelled")
    place = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    least = found.groupBy("class").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Rows to drop: members of a class of several rows, apart from those equal in id and text to the one that stays.
    gone = (
        skew_join(found, least, ["class"], ["doc_id", "key"], floor=HOT_ROWS).filter((F.col("key") != F.col("kept.key")) | ~F.col("doc_id").eqNullSafe(F.col("kept.doc_id")))
        .select("key", F.array("doc_id").alias("id")).distinct()
    )
    # NULL equals NULL inside an array. The row is one column, so that its columns clash with none of these.
    marked = docs.select(F.struct("*").alias("row"), text_key(F.col(text_column)).alias("key"), F.array(id_column).alias("id"), F.col(text_column).alias("text"))
    kept = marked.join(gone, ["key", "id"], "left_anti")
    repeated = found.groupBy("key", "doc_id").count().filter("count > 1")
    if not repeated.isEmpty():
        words_in = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
        kept = kept.filter(words_in).dropDuplicates(["key", "id"]).unionByName(kept.filter(~words_in))
    return in_few(kept.select("row.*"), found.count(), TEXT_ROWS)
