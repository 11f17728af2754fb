"""Operator 9: benchmark decontamination by a BM25 index of test items and block-max WAND.

The index is of the test items; every passage of every training text is a query. Passages are windows of
twice as many words as the longest item, one starting at every multiple of that number, so an item that a
text contains lies wholly within one. A term's impact on an item is its BM25 weight over the score of the
item against itself, so scores are shares: 1 if a passage has all terms of an item. All items with a share of
at least `SCORE` are retrieved, then verified: at least `QUESTION` of the five-word shingles of the item's
question and `ANSWER` of the distinct words of its answer are in the passage. The answer is an item's last
line, or the last third of its words where it has one line.

Items are numbered by length, so that neighbours have alike impacts, and dealt into blocks. The sum of a
passage's block maxima bounds its score in every block at once; only blocks whose bound reaches the threshold
are opened. In an open block WAND moves through the postings of the passage's terms in item order and skips
items whose summed maxima stay below the threshold, first by the terms' maxima, then by the maxima of short
runs of postings.

Postings are sent to the tasks in parts of at most `PART_POSTINGS`; with more, items are dealt into more
parts and the texts are searched once per part. Term statistics are of all items.

Every distinct pair of id and text is an item of its own: an id with several texts is reported once per text
found, and items without an id are reported with a null id.

Defined results: null and empty texts and items match nothing; repeated rows of texts come back repeated; items
of equal text and different ids are all found; without items nothing is found; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from zonewatch.llm.common import long_rows
from zonewatch.llm.hashing import SHINGLE, row_words, shingle_hashes, word_hashes
from zonewatch.session import materialize, release

K1, B = 1.2, 0.75
SCORE, QUESTION, ANSWER = 0.5, 0.5, 0.5
RUN = 64
BLOCK_ITEMS = 4
#: Numbers in the table of block maxima; blocks get larger where more would be needed.
BLOCK_TABLE = 1 << 24
PART_POSTINGS = 2_000_000


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    head, line, tail = text.strip().rpartition("\n")
    if line and head.strip():
        return words_of(head), words_of(tail)
    h = words_of(text)
    cut = len(h) - max(1, len(h) // 3) if len(h) > 1 else len(h)
    return h[:cut], h[cut:]


def share_in(part: np.ndarray, words: np.ndarray, by_shingle: bool) -> float:
    """The share of a part's distinct shingles (or words) that a passage has; 1 for an empty part.
    A part of fewer than five words is one shingle of all its words."""
    if not len(part):
        return 1.0
    if by_shingle:
        k = min(SHINGLE, len(part))
        part, words = shingle_hashes(part, k), shingle_hashes(words, k) if len(words) >= k else words[:0]
    part = np.unique(part)
    return float(np.isin(part, words).mean())


class Index:
    """Postings of some items, with block maxima, and what verification needs of them."""

    def __init__(self, items: list[tuple], terms: np.ndarray, item: np.ndarray, impact: np.ndarray, longest: int):
        """`items` are (id, text); terms, item (position in `items`) and impact are parallel, in any order."""
        order = np.lexsort((item, terms))
        terms, self.item, self.impact = terms[order], item[order], impact[order]
        self.terms, first = np.unique(terms, return_index=True)
        self.first = np.append(first, len(terms))
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.runs = []  # per term: last item and largest impact of each run of postings
        for a, b in zip(self.first[:-1], self.first[1:]):
            starts = np.arange(a, b, RUN)
            self.runs.append((self.item[np.append(starts[1:], b) - 1], np.maximum.reduceat(self.impact, starts)))
        self.width = max(BLOCK_ITEMS, -(-len(items) * max(1, len(self.terms)) // BLOCK_TABLE))
        self.bounds = np.zeros((len(self.terms), -(-len(items) // self.width)), dtype=np.float32)
        np.maximum.at(self.bounds, (np.repeat(np.arange(len(self.terms)), np.diff(self.first)), self.item // self.width),
                      np.nextafter(self.impact.astype(np.float32), np.float32(2)))
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        self.step = max(1, longest)

    def retrieve(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """(item, score) of all items with at least the score. `terms` are distinct positions of terms."""
        bound = self.bounds[terms].sum(axis=0)
        return [x for b in np.flatnonzero(bound >= least - 1e-4) for x in self._wand(terms, least, int(b) * self.width, int(b + 1) * self.width)]

    def _wand(self, terms: np.ndarray, least: float, low: int, high: int) -> list[tuple[int, float]]:
        """Items from `low` to below `high`, by block-max WAND."""
        at = []
        for t in terms:
            a, b = int(self.first[t]), int(self.first[t + 1])
            i, j = np.searchsorted(self.item[a:b], (low, high))
            if i < j:
                at.append([a + int(i), a + int(j), int(t)])
        found = []
        least -= 1e-9
        while at:
            at.sort(key=lambda c: self.item[c[0]])
            total, pivot = 0.0, -1
            for k, c in enumerate(at):
                total += self.most[c[2]]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            d = self.item[at[pivot][0]]
            while pivot + 1 < len(at) and self.item[at[pivot + 1][0]] == d:
                pivot += 1
            bound, until = 0.0, None
            for c in at[:pivot + 1]:
                last, most = self.runs[c[2]]
                k = int(np.searchsorted(last, d))
                if k < len(last):
                    bound += most[k]
                    until = int(last[k]) if until is None else min(until, int(last[k]))
            if bound < least:
                # no item up to the end of the nearest block can do it, nor before the next list's item
                to = d + 1 if until is None else until + 1
                if pivot + 1 < len(at):
                    to = min(to, int(self.item[at[pivot + 1][0]]))
                self._advance(at, pivot + 1, max(to, int(d) + 1))
            elif self.item[at[0][0]] == d:
                score = float(sum(self.impact[c[0]] for c in at[:pivot + 1]))
                if score >= least:
                    found.append((int(d), score))
                self._advance(at, pivot + 1, int(d) + 1)
            else:
                self._advance(at, pivot, int(d))
        return found

    def _advance(self, at: list, count: int, to: int) -> None:
        for c in at[:count]:
            c[0] += int(np.searchsorted(self.item[c[0]:c[1]], to))
        at[:] = [c for c in at if c[0] < c[1]]

    def search(self, h: np.ndarray, score: float, question: float, answer: float) -> dict[int, tuple[int, float, float, float]]:
        """Per item found in a text (its word hashes): passages, best score, overlaps of question and answer."""
        out: dict[int, tuple[int, float, float, float]] = {}
        if not len(h) or not len(self.terms):
            return out
        t = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[t] == h
        # distinct terms per piece of `step` words, and per piece the bounds of all blocks; a passage is two pieces
        place = np.flatnonzero(known)
        if not len(place):
            return out
        pairs = np.unique((place // self.step) * len(self.terms) + t[place])
        piece, term = pairs // len(self.terms), pairs % len(self.terms)
        heads = np.flatnonzero(np.diff(piece, prepend=-1))
        held = np.zeros((int(piece[-1]) + 2, self.bounds.shape[1]), dtype=np.float32)
        held[piece[heads]] = np.add.reduceat(self.bounds[term], heads)
        may = (held[:-1] + held[1:]).max(axis=1) >= score - 1e-4
        first = np.searchsorted(piece, np.arange(len(held) + 1))
        last = max(0, -(-len(h) // self.step) - 2)  # the passage at the end holds the piece after the last start
        for k in np.flatnonzero(may):
            if k > last:
                continue
            a, b = int(k) * self.step, min(len(h), (int(k) + 2) * self.step)
            terms = np.unique(term[first[k]:first[k + 2]])
            for d, s in self.retrieve(terms, score):
                q = share_in(self.parts[d][0], h[a:b], True)
                w = share_in(self.parts[d][1], h[a:b], False)
                if q >= question and w >= answer:
                    n, s0, q0, w0 = out.get(d, (0, 0.0, 0.0, 0.0))
                    out[d] = (n + 1, max(s, s0), max(q, q0), max(w, w0))
        return out


def build(benchmark: DataFrame, part_postings: int = PART_POSTINGS, nameless: bool = False) -> list[Index]:
    """Indexes of all items of (item_id, text), those without an id if asked for, in parts of bounded size."""
    long_rows(benchmark.sparkSession)
    items = materialize(benchmark.filter(F.col("item_id").isNotNull() | F.lit(nameless))
                        .select(F.coalesce("text", F.lit("")).alias("text"), "item_id").distinct()
                        .select(F.monotonically_increasing_id().alias("number"), "text", "item_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, term, tf, n = [], [], [], []
            for r, h in row_words(batch.column(1)):
                u, k = np.unique(h, return_counts=True)
                ids += [batch.column(0)[r].as_py()] * len(u)
                term += u.view(np.int64).tolist()
                tf += k.tolist()
                n += [len(h)] * len(u)
            yield pa.record_batch([pa.array(ids, batch.column(0).type), pa.array(term, pa.int64()), pa.array(tf, pa.int64()), pa.array(n, pa.int64())],
                                  names=["number", "term", "tf", "n"])

    postings = materialize(items.select("number", "text").mapInArrow(count, "number long, term long, tf long, n long"))
    size = postings.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("longest")).first()
    if not size["rows"]:
        release(items, postings)
        return []
    lengths = postings.groupBy("number").agg(F.max("n").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("mean")).first()
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((lengths["k"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / lengths["mean"]))
    scored = postings.join(df, "term").select("number", "term", impact.alias("impact"))
    own = scored.groupBy("number").agg(F.sum("impact").alias("self"))
    parts = -(-size["rows"] // part_postings)
    part = F.pmod(F.xxhash64("number"), F.lit(parts))
    scored = materialize(scored.join(own, "number").select("number", "term", (F.col("impact") / F.col("self")).alias("impact"), part.alias("part")))
    out = []
    for p in range(parts):
        held = sorted(((r["number"], r["item_id"], r["text"]) for r in items.filter(part == p).collect()), key=lambda x: (len(words_of(x[2])), x[0]))
        rows = scored.filter(F.col("part") == p).select("number", "term", "impact").toArrow()
        where = {x[0]: k for k, x in enumerate(held)}
        at = np.array([where[i] for i in rows.column("number").to_pylist()], dtype=np.int64)
        out.append(Index([x[1:] for x in held], rows.column("term").to_numpy().astype(np.int64).view(np.uint64), at, rows.column("impact").to_numpy(), size["longest"]))
    release(items, postings, scored)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, question: float = QUESTION, answer: float = ANSWER,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item (id and text) found in it: doc_id, item_id, n_passages, score, overlaps."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_type, item_type = dict(rows.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {doc_type}, item_id {item_type}, n_passages long, score double, question_overlap double, answer_overlap double"
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = [rows.mapInArrow(_finder(index, score, question, answer, kind), schema) for index in build(benchmark, nameless=True)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _finder(index: Index, score: float, question: float, answer: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items, rest = [], [], []
            for r, h in row_words(batch.column(1)):
                for d, values in sorted(index.search(h, score, question, answer).items()):
                    docs.append(r)
                    items.append(index.ids[d])
                    rest.append(values)
            n, s, q, w = zip(*rest) if rest else ((), (), (), ())
            yield pa.record_batch([batch.column(0).take(pa.array(docs, pa.int64())), pa.array(items, kind),
                                   pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array(q, pa.float64()), pa.array(w, pa.float64())],
                                  names=["doc_id", "item_id", "n_passages", "score", "question_overlap", "answer_overlap"]) if rest else _none(batch)

    def _none(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0).slice(0, 0), pa.array([], kind), *[pa.array([], t) for t in (pa.int64(), *[pa.float64()] * 3)]],
                               names=["doc_id", "item_id", "n_passages", "score", "question_overlap", "answer_overlap"])
    return run


def clean(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, question: float = QUESTION, answer: float = ANSWER,
          text_col: str = "text") -> DataFrame:
    """The rows of `docs` in whose text no item is found."""
    for index in build(benchmark, nameless=True):
        docs = docs.filter(~_flag(index, score, question, answer)(F.col(text_col)))
    return docs


def _flag(index: Index, score: float, question: float, answer: float):
    @F.pandas_udf("boolean")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            column = pa.array(texts, pa.string(), from_pandas=True)
            yield pd.Series([bool(index.search(h, score, question, answer)) for _, h in row_words(column)], dtype=bool)
    return found
