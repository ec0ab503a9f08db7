"""Periodic runs of words: stretches that repeat themselves three times or more, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least ``LEAST`` words and
three periods that no neighbouring word extends.  The method is online square catching.  Words are appended one by
one; once a dyadic block of 2^k words is complete, a *catcher* looks for its copy 2^k to 2^(k+1) - 1 words later (1 to
15 for the smallest blocks, of 8 words).  Every appended word advances all catchers alive by one step of their
suffix comparison (failure function of the block).  A copy found q words later opens a stretch of period q, to the left
as far as words q apart agree, and further appended words extend it: each new square of the period merges into it.  At the
first disagreement it closes and is reported if it is long enough and has no smaller period.

That misses no run: of period q in [2^k, 2^(k+1)) and length 3q (or q < 16 and length 24), its first 2^k (8) words hold
the start of a complete block whose copy q words later lies in the run as well.  Blocks without an early enough copy
need no catcher; this is known beforehand from hashes of all windows of 8 words, which serve as a filter only.

Texts are independent, so there is no shuffle; a task holds one slice of texts.  Defined cases: null and empty texts have no
words and no runs; words are separated by ASCII white space only; equal rows get equal results; other columns are
kept, except those of the names added here, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.llm.common import slices

#: Words of the shortest run; periods that a run has at least; words of the smallest block.
LEAST, TIMES, BLOCK = 24, 3, 8
FAR = np.iinfo(np.int64).max


def near_copies(hashes: list[np.ndarray]) -> list[np.ndarray | None]:
    """For the complete 8-word blocks of every text the distance to their next copy (``FAR`` if none), by hashes of the
    words; None where no block has one."""
    sizes = np.array([len(h) for h in hashes])
    starts = np.append(0, np.cumsum(sizes))
    h = np.concatenate(hashes).astype(np.uint64) if len(hashes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(hashes), dtype=np.int64), sizes)
    for step in (1, 2, 4):
        h = (h[: len(h) - step] if len(h) > step else h[:0]) * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ (h[step:] >> np.uint64(29)))
    n = len(h)
    found: list[np.ndarray | None] = [None] * len(hashes)
    if not n:
        return found
    inside = np.flatnonzero(owner[:n] == owner[BLOCK - 1 : BLOCK - 1 + n])
    key = (h[inside] ^ owner[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
    block = (inside - starts[owner[inside]]) % BLOCK == 0
    place = (key >> np.uint64(42)).astype(np.int64)
    marked = np.zeros(1 << 22, bool)
    marked[place[block]] = True
    some = np.flatnonzero(marked[place])
    order = some[np.argsort(key[some], kind="stable")]
    at, keys, is_block = inside[order], key[order], block[order]
    pairs = np.flatnonzero((keys[1:] == keys[:-1]) & is_block[:-1])
    for k, far in zip(at[pairs].tolist(), (at[pairs + 1] - at[pairs]).tolist()):
        text = owner[k]
        if found[text] is None:
            found[text] = np.full(sizes[text] // BLOCK, FAR)
        found[text][(k - starts[text]) // BLOCK] = far
    return found


def completions(near: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Blocks that get a catcher: (word at which it starts to listen, start of the block, its length), in order."""
    events, size = [], BLOCK
    while TIMES * size <= max(n, LEAST) and len(near):
        for j in np.flatnonzero(near < 2 * size).tolist():
            events.append(((j + 1) * size, j * size, size))
        near = np.maximum(near[0 : len(near) // 2 * 2 : 2], near[1::2])
        size *= 2
    events.sort(key=lambda e: (e[0], e[2]))
    return events


def failures(block: list) -> list[int]:
    """Length of the longest proper border of every prefix of a block."""
    fail, k = [0] * (len(block) + 1), 0
    for i in range(1, len(block)):
        while k and block[i] != block[k]:
            k = fail[k]
        k += block[i] == block[k]
        fail[i + 1] = k
    return fail


class Catcher:
    """Looks for copies of a complete block whose start is ``first`` to ``last`` words after its own."""

    __slots__ = ("start", "block", "fail", "matched", "until")

    def __init__(self, words: list, start: int, size: int):
        self.start, self.block = start, words[start : start + size]
        self.fail, self.matched = failures(self.block), 0
        self.until = start + 3 * size - 1  # words from here on cannot end a copy in reach
        if size == BLOCK:  # these also catch smaller periods: words inside the block are compared as well
            for word in self.block[1:]:
                self.advance(word)

    def advance(self, word) -> bool:
        """One more word; whether it completes a copy."""
        block, k = self.block, self.matched
        if k == len(block):
            k = self.fail[k]
        while k and block[k] != word:
            k = self.fail[k]
        if block[k] == word:
            k += 1
        self.matched = k
        return k == len(block)


def primitive(words: list, start: int, period: int) -> bool:
    """Whether a stretch of three periods or more has no smaller period."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            d = period // factor
            if words[start : start + period] == words[start + d : start + d + period]:
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def catch(words: list, near: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text, by start and period; ``near`` as ``near_copies`` gives it."""
    n, runs = len(words), []
    events = completions(near, n)
    catchers: list[Catcher] = []
    stretches: dict[int, int] = {}  # start of the open stretch of a period; all of them reach the last word

    def close(period: int, end: int) -> None:
        start = stretches.pop(period)
        if end - start >= max(LEAST, TIMES * period) and primitive(words, start, period):
            runs.append((start, end - start, period))

    i = coming = 0
    while i < n:
        while coming < len(events) and events[coming][0] <= i:
            _, start, size = events[coming]
            catchers.append(Catcher(words, start, size))
            coming += 1
        if not catchers and not stretches:  # nothing listens: on to the next complete block
            if coming == len(events):
                break
            i = max(i, events[coming][0])
            continue
        word = words[i]
        for period in [q for q in stretches if words[i - q] != word]:
            close(period, i)
        over = False
        for c in catchers:
            if c.advance(word):
                period = i + 1 - len(c.block) - c.start
                if (len(c.block) <= period or len(c.block) == BLOCK) and period not in stretches and not any(period % q == 0 and stretches[q] <= c.start for q in stretches):
                    left = c.start
                    while left and words[left - 1] == words[left - 1 + period]:
                        left -= 1
                    stretches[period] = left
            over |= c.until <= i + 1
        if over:
            catchers = [c for c in catchers if c.until > i + 1]
        i += 1
    for period in list(stretches):
        close(period, n)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[k] for k in np.flatnonzero(~gone).tolist()]


def _worker(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text):
            words = [(t or b"").split() for t in part.column(text).cast(pa.binary()).to_pylist()]
            runs = []
            for one, near in zip(words, near_copies([np.fromiter(map(hash, w), np.int64, len(w)) for w in words])):
                if near is None:
                    runs.append([])
                    continue
                numbers: dict = {}
                runs.append(catch([numbers.setdefault(w, len(numbers)) for w in one], near))
            found = {
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "runs": pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], schema.field("runs").type),
                "collapsed": pa.array([b" ".join(collapsed(w, r)) for w, r in zip(words, runs)], pa.binary()).cast(pa.string()),
            }
            yield pa.RecordBatch.from_arrays([found[f.name] if f.name in found else part.column(f.name).cast(f.type) for f in schema], schema=schema)


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``runs`` (start, length and period in words, by start and period) and
    ``collapsed`` (the words outside repeats, joined by one space)."""
    kept = [c for c in docs.columns if c not in (text, "n_words", "runs", "collapsed")]
    name = "_text"
    while name in kept:
        name += "_"
    rows = docs.select(*kept, F.col(text).alias(name))
    schema = StructType([*[docs.schema[c] for c in kept], *StructType.fromDDL(f"n_words long, runs array<{RUN}>, collapsed string").fields])
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(lambda batches: _worker(batches, name, arrow), schema)
