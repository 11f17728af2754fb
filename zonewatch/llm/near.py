"""Operator 10: Jaccard self-join of word shingles by prefix filters under several token orders.

A document's set holds the hashes of its distinct five-word shingles. If two sets reach the threshold,
they share enough tokens among the first few tokens of each under *any* order of all tokens. So a pair
is verified only if it does so under the first order and under the second. Both orders put tokens that are
common in the corpus last and break ties by different hashes, so passages that many documents share
hardly ever bring two documents together.

How many shared tokens are enough: with prefixes of n - ceil(t n) + 1 tokens, the set whose prefix ends
first holds ceil(t n) - 1 tokens behind it, so the overlap is at most the count of tokens shared in the
prefixes plus that number, and at threshold t it is at least t (n + m) / (1 + t).

What is common is read from one count array per order (`ORDER_CELLS` cells each, filled from all rows and
sent to the tasks): tokens are ordered by how far their cell lies above the mean. It decides how many
candidates there are, never which links are found: any order gives the same result. Raise the number of
cells with the corpus (about a cell per thousand tokens).

A shared token is only looked at where the tokens behind it still leave the threshold in reach, which
holds for the first token that a linked pair shares; so groups of similar but unlinked texts meet rarely.

Equal sets are one class from the start. The classes of a near-copy group would still make every pair of
the group a candidate, so links are sought in two rounds: first only between the members of a token's
group and its head (the class with the fewest rare tokens, most often the original), then, once
linked classes are one component, between members of different components. The second round looks at
all such pairs, so no component is split; pairs within a component are not looked at again.

Defined results: null and empty texts have no set and link with nothing; one to four words make one
token; rows with a null id take part and get the component of their text's class (null if no member
has an id); repeated rows come back repeated; an empty table gives an empty result; other columns
are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewatch.llm.common import add_pieces, fixed_counts, long_rows, pieces_of
from zonewatch.llm.components import connected
from zonewatch.llm.hashing import mix, row_sets, set_digest
from zonewatch.session import materialize, release

PERCENT = 80
ORDER_CELLS = 1 << 20
SEEN_BITS = 1 << 21
ORDERS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """0 to 127 by how far a cell is from the mean: quarters of a deviation up to twelve, then log steps."""
    mean = counts.mean() if len(counts) else 0.0
    z = (counts - mean) / max(1.0, np.sqrt(mean))
    far = 64 + 4 * np.log2(np.maximum(z, 12) / 12)
    return np.clip(np.where(z <= 12, np.floor(4 * z) + 16, far), 0, 127).astype(np.uint8)


#: Levels below this one are within four deviations of the mean.
RARE = 32


def cells_of(tokens: np.ndarray, order: np.uint64, cells: int) -> np.ndarray:
    return (mix(tokens ^ order) & np.uint64(cells - 1)).astype(np.int64)


def prefix(tokens: np.ndarray, levels: np.ndarray, order: np.uint64, percent: int) -> np.ndarray:
    """The first tokens under an order: as many as a set at the threshold can miss, and one."""
    n = len(tokens)
    p = n - -(-percent * n // 100) + 1
    key = (levels[cells_of(tokens, order, len(levels))].astype(np.uint64) << np.uint64(57)) | (mix(tokens ^ order) >> np.uint64(7))
    first = np.argpartition(key, p - 1)[:p] if p < n else np.arange(n)
    return tokens[first[np.argsort(key[first], kind="stable")]]


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _profile(docs: DataFrame, id_type: str, cells: int) -> DataFrame:
    """Per row its id, set size and digest; per task the pieces of its token counts."""
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * cells, dtype=np.int32)
        names = ["id", "n", "d1", "d2", "slice", "piece"]
        for batch in batches:
            size, d1, d2 = [], [], []
            for _, tokens in row_sets(batch.column(1)):
                size.append(len(tokens))
                x, y = set_digest(tokens) if len(tokens) else (None, None)
                d1.append(x)
                d2.append(y)
                for k, order in enumerate(ORDERS):
                    np.add.at(total, cells_of(tokens, order, cells) + k * cells, 1)
            m = len(size)
            yield pa.record_batch([batch.column(0).cast(arrow_id), pa.array(size, pa.int64()), pa.array(d1, pa.int64()),
                                   pa.array(d2, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        pieces = pieces_of(total, 64)
        m = pieces.num_rows
        yield pa.record_batch([pa.nulls(m, arrow_id), *[pa.nulls(m, pa.int64())] * 3, *pieces.columns], names=names)

    return docs.mapInArrow(run, f"id {id_type}, n long, d1 long, d2 long, slice int, piece binary")


def _classes(docs: DataFrame, id_type: str, levels: np.ndarray, percent: int) -> DataFrame:
    """One row per distinct set: smallest id, size, count of rare tokens, prefix under the first order."""
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, size, d1, d2, rare, first = [], [], [], [], [], []
            for r, tokens in row_sets(batch.column(1)):
                if len(tokens):
                    x, y = set_digest(tokens)
                    keep.append(r)
                    size.append(len(tokens))
                    d1.append(x)
                    d2.append(y)
                    rare.append(int((levels[cells_of(tokens, ORDERS[0], len(levels))] < RARE).sum()))
                    first.append(prefix(tokens, levels, ORDERS[0], percent))
            yield pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())).cast(arrow_id), pa.array(d1, pa.int64()),
                                   pa.array(d2, pa.int64()), pa.array(size, pa.int64()), pa.array(rare, pa.int64()), _lists(first)],
                                  names=["id", "d1", "d2", "n", "rare", "first"])

    rows = docs.mapInArrow(run, f"id {id_type}, d1 long, d2 long, n long, rare long, first array<long>")
    distinct = rows.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first(F.struct("n", "rare", "first")).alias("x"))
    # heads are the smallest numbers, so the number starts with the count of rare tokens; the rest is
    # the task (17 bits) and the row in it (28 bits), fixed once the table is written
    at = F.monotonically_increasing_id()
    number = (F.shiftleft(F.least("x.rare", F.lit((1 << 17) - 1)), 45).bitwiseOR(F.shiftleft(F.shiftright(at, 33), 28))
              .bitwiseOR(at.bitwiseAND(F.lit((1 << 28) - 1))))
    fits = (F.shiftright(at, 33) < 1 << 17) & (at.bitwiseAND(F.lit((1 << 33) - 1)) < 1 << 28)
    checked = F.when(fits, number).otherwise(F.raise_error(F.lit("more than 2^17 tasks, or 2^28 sets in one: set the shuffle partitions in between")))
    return distinct.select(checked.alias("class"), "d1", "d2", "id", "x.n", "x.first")


def _sets(docs: DataFrame, wanted: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """Whole sets and second prefixes of the wanted classes. Rows that cannot be wanted stop at the
    scan: a bit array of fixed size, filled from all wanted digests, is sent to the tasks."""
    bits = fixed_counts(wanted.select("d1"), SEEN_BITS, lambda b: iter([_bit(b.column(0).to_numpy())])) > 0
    packed = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(packed).astype(bool)
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            d1, d2, size, sets, second = [], [], [], [], []
            for _, tokens in row_sets(batch.column(0)):
                if not len(tokens):
                    continue
                x, y = set_digest(tokens)
                if seen[_bit(np.array([x]))[0]] and (x, y) not in sent:
                    if len(sent) < 100_000:  # repeats are merged below in any case
                        sent.add((x, y))
                    d1.append(x)
                    d2.append(y)
                    size.append(len(tokens))
                    sets.append(tokens.tobytes())
                    second.append(prefix(tokens, levels, ORDERS[1], percent))
            yield pa.record_batch([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(size, pa.int64()),
                                   pa.array(sets, pa.binary()), _lists(second)], names=["d1", "d2", "n", "tokens", "second"])

    rows = docs.select("text").mapInArrow(run, "d1 long, d2 long, n long, tokens binary, second array<long>")
    once = rows.groupBy("d1", "d2").agg(F.first(F.struct("n", "tokens", "second")).alias("x"))
    return wanted.join(once, ["d1", "d2"]).select("class", "x.n", "x.tokens", "x.second")


def _bit(digests: np.ndarray) -> np.ndarray:
    return (digests.astype(np.int64).view(np.uint64) % np.uint64(SEEN_BITS)).astype(np.int64)


def _near_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))


def _enough(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether so many tokens shared in the prefixes leave the threshold in reach."""
    behind = F.floor((percent * F.greatest(n, m) + 99) / 100) - 1
    return (100 + percent) * (shared + behind) >= percent * (n + m)


def _in_reach(a: str, b: str, percent: int) -> Column:
    """Whether the tokens at and behind a shared one leave the threshold in reach."""
    na, nb, ia, ib = (F.col(c) for c in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    return (100 + percent) * F.least(na - ia, nb - ib) >= percent * (na + nb)


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of tokens that at least two classes have, each with the head of its token's group."""
    heads = (postings.groupBy("token").agg(F.min(F.struct("class", "n")).alias("head"), F.count(F.lit(1)).alias("k"))
             .filter("k > 1").select("token", "head"))
    return postings.join(heads, "token").select("token", "class", "n", "pos", F.col("head.class").alias("h_class"), F.col("head.n").alias("h_n"))


def _enough_shared(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share enough tokens of their prefixes; `prefixes` has the tokens others have too."""
    a, b = (prefixes.select(F.col("class").alias(x), F.col("n").alias(f"{x}_n"), F.col("tokens").alias(f"{x}_tokens")) for x in "ab")
    met = pairs.join(a, "a").join(b, "b")
    return met.filter(_enough(F.size(F.array_intersect("a_tokens", "b_tokens")), F.col("a_n"), F.col("b_n"), percent)).select("a", "b")


def _star(shared: DataFrame, percent: int) -> DataFrame:
    """Heads and members of token groups."""
    return (shared.filter("class != h_class").filter(_near_size("n", "h_n", percent))
            .select(F.col("h_class").alias("a"), F.col("class").alias("b")).distinct())


def _across(shared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share a token with the threshold in reach."""
    own = (shared.select("token", "class", "n", "pos").join(labels, shared["class"] == labels["node"], "left")
           .select("token", "class", "n", "pos", F.coalesce("component", "class").alias("component")))
    mixed = (own.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter("lo < hi").select("token"))
    own = own.join(mixed, "token", "left_semi")
    a, b = (own.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("class", "n", "pos", "component")]) for x in "ab")
    met = (a.join(b, "token").filter("a_class < b_class AND a_component != b_component")
           .filter(_near_size("a_n", "b_n", percent) & _in_reach("a_", "b_", percent)))
    return met.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the second order's filter and then reach the threshold."""
    a, b = (sets.select(F.col("class").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "tokens", "second")]) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(r)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    both = pairs.join(a, "a").join(b, "b").filter(
        _enough(F.size(F.array_intersect("a_second", "b_second")), F.col("a_n"), F.col("b_n"), percent))
    return both.select("a", "b", "a_tokens", "b_tokens").mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    order_cells: int = ORDER_CELLS) -> DataFrame:
    """Per row of `docs`: its id, its number of distinct shingles, and the smallest id of its component."""
    long_rows(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(docs.dtypes)["id"]
    profile = materialize(_profile(docs, id_type, order_cells))
    counts = add_pieces(profile.filter("slice IS NOT NULL").select("slice", "piece"), 2 * order_cells)
    levels = [levels_of(c) for c in np.split(counts, 2)]
    rows = profile.filter("slice IS NULL").select("id", "n", "d1", "d2")

    classes = materialize(_classes(docs, id_type, levels[0], percent))
    shared = materialize(_shared(classes.select("class", "n", F.posexplode("first").alias("pos", "token"))))
    prefixes = materialize(shared.groupBy("class").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens")))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = materialize(_enough_shared(pairs, prefixes, percent))
        wanted = materialize(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
                             .join(classes.select("class", "d1", "d2"), "class"))
        sets = materialize(_sets(docs, wanted, levels[1], percent))
        found = materialize(_verified(pairs, sets, percent))
        release(pairs, wanted, sets)
        return found

    first = linked(_star(shared, percent))
    labels = connected(first)
    second = linked(_across(shared, labels, percent))
    final = connected(first.union(second))
    release(shared, prefixes, labels, first, second)

    named = (classes.select("class", "d1", "d2", "id").join(final, F.col("class") == F.col("node"), "left")
             .select("d1", "d2", "id", F.coalesce("component", "class").alias("component")))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("d1", "d2", "component_id")
    return (rows.join(named, ["d1", "d2"], "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))
