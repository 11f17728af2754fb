"""Periodic runs of words, by seeds on diagonals of a text against itself.

A run is a stretch with smallest period q, at least max(6, 4q) words long, that no neighbouring word extends. On
the diagonal of lag q it is at least max(6 - q, 3q) matching words in a row. So lags from 2^j on, below 2^(j+1), are
sought by k-grams of k = 3 * 2^j words (5 for lag 1), the least overlap that such a run has:

* `seeds`: k-grams that occur again in the same text are indexed, with the places where they do. Since k is at
  least the lag, a k-gram of a run comes again exactly one period later and not earlier; so of all pairs of
  occurrences only neighbouring ones with a lag in range are seeds. A place whose k-gram stands alone has none at
  longer k either, so each level looks at the places that the last one left.
* `runs_of`: per lag, seeds that lie before what the last extension on that lag covered are skipped; others are
  extended word by word in both directions and kept if they are long enough.

A kept stretch has no smaller period (that would divide q, and the k-gram would come again earlier). As matches of
a seed are longer than the lag, the extended stretches are repetitions of exponent above 2, of which a text of n
words has fewer than n, however it is made.

Texts of an Arrow batch are worked on together in pieces of about a megabyte, a longer text as one piece of its own.
Words become numbers exactly (a dictionary per piece); k-grams are compared by 64-bit hashes and every extension by
the words themselves. A number of its own ends each text, so nothing matches across texts.

Defined cases: a null text has no words, like an empty one; a null id is given back as it is and nothing is
planted for it; equal texts and repeated rows are rows of their own. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.llm.common import long_rows
from zonewatch.llm.hashing import chunks, mix, text_bytes, word_spans

LEAST_WORDS, LEAST_PERIODS = 6, 4
SPACE = 0x20
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * _LEFT + mix(b + _RIGHT))


def word_numbers(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Equal words, equal numbers."""
    heads = np.cumsum(lengths) - lengths
    flat = raw[np.repeat(starts - heads, lengths) + np.arange(int(lengths.sum()))]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                  [None, pa.py_buffer(np.append(heads, len(flat)).astype(np.int64)), pa.py_buffer(flat)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def seeds(w: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per level the lags and places of its seeds, sorted by both. w: word numbers, each text ended by a number of
    its own; longest: words of the longest text."""
    with np.errstate(over="ignore"):
        pair = {1: mix(w.astype(np.uint64) + _LEFT)}  # hashes of 2^i words from each place on

    def grams(k: int) -> np.ndarray:
        """Hashes of k words at each place (those that would go beyond the end are left out)."""
        half = 1
        while half * 2 <= k:
            if half * 2 not in pair:
                h = pair[half]
                pair[half * 2] = _join(h[:len(h) - half], h[half:])
            half *= 2
        h = pair[half]
        return h if half == k else _join(h[:len(w) - k + 1], h[k - half:])
    at, j = np.arange(len(w)), 0
    while len(at) and max(LEAST_WORDS, LEAST_PERIODS << j) <= longest:
        k = LEAST_WORDS - 1 if j == 0 else 3 << j
        at = at[at <= len(w) - k]
        if not len(at):
            return
        h = grams(k)[at]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        lag = at[order][1:] - at[order][:-1]
        of_level = same & (lag >= 1 << j) & (lag < 2 << j)
        lags, places = lag[of_level], at[order][:-1][of_level]
        by = np.lexsort((places, lags))
        yield lags[by], places[by]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        at, j = at[again], j + 1


def _matching(w: np.ndarray, a: int, q: int, step: int) -> int:
    """How many places from a on (by +1, or by -1 from a - 1 on) hold the same word as q further on."""
    n, size = 0, 64
    while True:
        if step > 0:
            x, y = w[a + n:a + n + size], w[a + n + q:a + n + q + size]
            x = x[:len(y)]
        else:
            lo = max(0, a - n - size)
            x, y = w[lo:a - n][::-1], w[lo + q:a - n + q][::-1]
        if not len(x):
            return n
        differ = np.flatnonzero(x != y)
        if len(differ):
            return n + int(differ[0])
        n, size = n + len(x), size * 2


def runs_of(w: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs in w, by start and period."""
    found = []
    for lags, places in seeds(w, longest):
        if not len(lags):
            continue
        heads = np.flatnonzero(np.append(True, (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)))
        lag, covered = 0, 0
        for q, p in zip(lags[heads].tolist(), places[heads].tolist()):
            if q != lag:
                lag, covered = q, 0
            if p < covered:
                continue
            start, end = p - _matching(w, p, q, -1), p + _matching(w, p, q, 1)
            covered = max(covered, end)
            if end - start + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((start, end - start + q, q))
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def planted(ids: pa.Array, rows: np.ndarray) -> np.ndarray | None:
    """Which word takes each word's place where h % 10 = 0 (h: crc32 of the decimal id); None if no text is changed."""
    source = None
    for r, id_ in enumerate(ids.to_pylist()):
        n = int(rows[r + 1] - rows[r])
        if id_ is None or not n or (h := zlib.crc32(str(id_).encode())) % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source = np.arange(rows[-1]) if source is None else source
        source[rows[r] + a:rows[r + 1]] = rows[r] + a + np.arange(n - a) % p
    return source


def _piece(ids: pa.Array, raw: np.ndarray, at: np.ndarray, plant: bool) -> Iterator[tuple]:
    """Per text: number of runs, the longest (start, length, period) or None, digests of runs and of kept words."""
    starts, lengths, rows = word_spans(raw, at)
    source = planted(ids, rows) if plant else None
    if source is not None:
        starts, lengths = starts[source], lengths[source]
    n, texts = len(starts), len(at) - 1
    w = word_numbers(raw, starts, lengths) if n else np.zeros(0, np.int64)
    ended = np.insert(w, rows[1:], n + np.arange(texts))  # the number after a text's last word
    shift = np.arange(texts + 1) + rows  # where each text starts in `ended`
    runs = runs_of(ended, int(np.diff(rows).max(initial=0)))
    of = np.searchsorted(shift, runs[:, 0], side="right") - 1
    runs[:, 0] -= of  # back to word numbers
    drop = np.zeros(n + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(drop[:n]) == 0
    # the kept words, each followed by a space
    starts, lengths = starts[kept], lengths[kept] + 1
    ends = np.append(0, np.cumsum(lengths))
    flat = np.repeat(starts - ends[:-1], lengths) + np.arange(int(ends[-1]))
    out = raw[np.minimum(flat, max(len(raw) - 1, 0))] if n else np.zeros(0, np.uint8)
    out[ends[1:] - 1] = SPACE
    text = out.tobytes()
    nth = np.append(0, np.cumsum(kept))[rows]  # kept words before each text
    heads = np.searchsorted(of, np.arange(texts + 1))
    for r in range(texts):
        mine = runs[heads[r]:heads[r + 1]]
        a, b = int(ends[nth[r]]), int(ends[nth[r + 1]])
        listed = "".join(f"{s - rows[r]},{m},{q}\n" for s, m, q in mine.tolist())
        best = None
        if len(mine):
            s, m, q = mine[np.lexsort((mine[:, 2], mine[:, 0], -mine[:, 1]))[0]].tolist()
            best = (s - int(rows[r]), m, q)
        yield (len(mine), best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text[a:max(a, b - 1)]).hexdigest(),
               mine - [int(rows[r]), 0, 0], text[a:max(a, b - 1)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, detail: bool = False) -> DataFrame:
    """Per row of `docs`: id, n_runs, its longest run (ties: smallest start, then period), and digests of its runs and
    of the text without repeats, in which a word goes if a run holds it after the run's first period. `detail` adds
    all runs and that text. `plant` first repeats a part of one text in ten, by its id."""
    long_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text_"))
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    fields = [T.StructField(c, T.LongType()) for c in numbers] + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]
    if detail:
        run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
        fields += [T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]
    schema = T.StructType([rows.schema[0], *fields])

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            got = []
            for i, j in chunks(at):
                got += _piece(batch.column(0).slice(i, j - i), raw[at[i]:at[j]], at[i:j + 1] - at[i], plant)
            longest = [g[1] or (None,) * 3 for g in got]
            col = lambda xs, t: pa.array(xs, t)
            cols = [batch.column(0), col([g[0] for g in got], pa.int64()), *(col([x[c] for x in longest], pa.int64()) for c in range(3)),
                    col([None if x[0] is None else 1000 * x[1] // x[2] for x in longest], pa.int64()),
                    col([g[2] for g in got], pa.string()), col([g[3] for g in got], pa.string())]
            if detail:
                of = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                cols += [col([[dict(zip(("start", "length", "period"), x)) for x in g[4].tolist()] for g in got], of),
                         col([g[5].decode("utf-8", "replace") for g in got], pa.string())]
            yield pa.record_batch(cols, names=schema.names)
    return rows.mapInArrow(run_batches, schema)
