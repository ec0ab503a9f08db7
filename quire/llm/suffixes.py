"""Removal of repeated byte strings by a column-wise suffix construction.

Every byte string of ``size`` bytes lies in exactly one short string around its minimizer (the gram with the least
hash in it), and equal byte strings have equal minimizers at the same place. So the suffixes of a whole collection
fall into independent collections of short strings, and within one, equal suffixes begin in the same column. The
construction goes through the columns from right to left: each round takes one symbol of every string, updates
the order of the suffixes (a stable sort by the new symbol) and the lengths of common prefixes of neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import binary_rows, bounds, slices, stored, swept, tidied, whole_groups

#: Bytes of a gram; a window of ``size`` bytes holds ``size - GRAM + 1`` of them.
GRAM = 20
#: Documents with one minimizer beyond which its strings are cut into single windows, dealt by their own hash.
HOT = 4096
#: Such minimizers that tasks are told of; where more pass ``HOT``, the most frequent ones count.
MOST_HOT = 200_000
#: Blocks of hashes that questions are dealt to, at least: fewer would leave executors idle.
LEAST_BUCKETS = 64
#: Text handled at a time in a task.
BATCH_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _short(keys: np.ndarray) -> np.ndarray:
    """The part of a minimizer that is asked for; two that share it are at worst shuffled in vain."""
    return (keys >> np.uint64(32)).astype("<u4")


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of the ``size`` bytes from each position on, by doubling."""
    step, done = data.astype(np.uint64) + np.uint64(1), np.zeros(len(data) + 1, np.uint64)
    width, covered = 1, 0
    while True:
        power = np.uint64(pow(int(_BASE), width, 1 << 64))
        if size & width:
            n = len(data) - covered - width + 1
            done = done[:n] * power + step[covered : covered + n]
            covered += width
        if covered == size:
            return done
        step = step[:-width] * power + step[width:]
        width *= 2


def minimizers(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of joined documents, as (document, first window, number of windows, place of the minimizer), and the
    hashes of all grams, of which the one at that place is the string's key."""
    if len(data) < size:
        return np.zeros((4, 0), np.int64), np.zeros(0, np.uint64)
    grams = _mix(rolling(data, GRAM))
    span = size - GRAM + 1
    least, place, width = grams, np.arange(len(grams), dtype=np.int32), 1
    while width < span:
        step = min(width, span - width)
        first = least[:-step] <= least[step:]
        place = np.where(first, place[:-step], place[step:])
        least = np.where(first, least[:-step], least[step:])
        width += step
    document = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    windows = np.flatnonzero(np.arange(len(place)) + size <= ends[document[: len(place)] + 1])
    if not len(windows):
        return np.zeros((4, 0), np.int64), grams
    at = place[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(windows)))
    first = windows[starts]
    return np.stack([document[first], first, counts, at[starts].astype(np.int64)]), grams


def column_order(symbols: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each column from right to left: the column, the strings in order of their suffixes from it on, and the
    common prefix of each with the one before. Symbols are positive; 0 stands where a string has none."""
    m, columns = symbols.shape
    order, common = np.arange(m), np.zeros(m, np.int32)
    for c in range(columns - 1, -1, -1):
        new = symbols[order, c]
        turn = np.argsort(new, kind="stable")
        sorted_new = new[turn]
        after = np.zeros(m, np.int32)
        edges = bounds(sorted_new)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1 and sorted_new[a]:
                # the least common prefix on the way from each to the next with the same symbol
                held = turn[a:b]
                after[a + 1 : b] = 1 + np.minimum.reduceat(common[: held[-1] + 1], held[:-1] + 1)
        order, common = order[turn], after
        if c <= columns - size:
            yield c, order, common


def least_owner(symbols: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """For each string and column: the smallest owner of a string with the same ``size`` symbols from there on."""
    m, columns = symbols.shape
    found = np.repeat(owner[:, None], columns - size + 1, axis=1)
    for c, order, common in column_order(symbols, size):
        runs = np.flatnonzero(common < size)
        least = np.minimum.reduceat(owner[order], runs)
        found[order, c] = np.repeat(least, np.diff(np.append(runs, m)))
    return found


def _spans(mask: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end of what the flagged windows of each row cover; end counts the whole last window."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    row, first = np.nonzero(change == 1)
    _, last = np.nonzero(change == -1)
    return row, first, last - 1 + size


def _per_document(doc: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    order = np.lexsort((first, h, doc))
    doc, h = doc[order], h[order]
    pairs = np.stack([first[order], last[order]], axis=1).astype("<i4")
    edges = bounds(doc, h)
    return doc[edges[:-1]], h[edges[:-1]], [pairs[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _asks(size: int, buckets: int):
    """Per batch: which minimizers its documents have, one entry each; and what is known to be shared already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "_text", BATCH_BYTES):
                data, ends = binary_rows(some.column("_text"))
                data, ends = data[ends[0] : ends[-1]], ends - ends[0]
                (document, _, _, place), grams = minimizers(data, ends, size)
                if not len(document):
                    continue
                ids = some.column("_id").to_numpy()
                keys, docs = _short(grams[place]), ids[document]
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                once = bounds(keys, docs)[:-1]
                keys, docs = keys[once], docs[once]
                edges = bounds(keys)
                counts = np.diff(edges)
                bucket = (keys[edges[:-1]] % np.uint32(buckets)).astype(np.int64)
                by = np.lexsort((docs[edges[:-1]], bucket))
                cut = bounds(bucket[by])
                rows = []
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    k = by[a:b]
                    e = edges[:-1][k]
                    own = bounds(docs[e])
                    several = np.flatnonzero(counts[k] > 1)
                    rows.append((int(bucket[k[0]]), keys[e].tobytes(), docs[e][own[:-1]].tobytes(), np.diff(own).astype("<u4").tobytes(), np.stack([several, counts[k][several]]).astype("<u4").tobytes()))
                many = np.repeat(counts > 1, counts)
                keys, docs = keys[many], docs[many]
                order = np.argsort(docs, kind="stable")
                keys, docs = keys[order], docs[order]
                cut = bounds(docs)
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    rows.append((-1 - a % buckets, keys[a:b].tobytes(), docs[a : a + 1].tobytes(), None, None))
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "keys", "docs", "runs", "several"])

    return run


def _answers(hot_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"]):
            yield from _answered(table, hot_from)

    return run


def _answered(table: pa.Table, hot_from: int) -> Iterator[pa.RecordBatch]:
    """Per document: its minimizers that more than one document has. Without one: those that very many have, and how many."""
    schema = ["_id", "keys", "counts"]
    bucket = table.column("bucket").to_numpy()
    cut = bounds(bucket)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        part = table.slice(lo, hi - lo)
        if bucket[lo] < 0:
            ids = np.frombuffer(b"".join(part.column("docs").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(part.column("keys").to_pylist(), pa.binary()), pa.nulls(len(ids), pa.binary())], schema)
            continue
        blobs = part.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(blobs), "<u4")
        docs = np.repeat(np.frombuffer(b"".join(part.column("docs").to_pylist()), "<i8"), np.frombuffer(b"".join(part.column("runs").to_pylist()), "<u4"))
        counts, first = np.ones(len(keys), np.int64), 0
        for blob, several in zip(blobs, part.column("several").to_pylist(), strict=True):
            at, n = np.frombuffer(several, "<u4").reshape(2, -1)
            counts[first + at] = n
            first += len(blob) // 4
        order = np.argsort(keys, kind="stable")
        edges = bounds(keys[order])
        total = np.repeat(np.add.reduceat(counts[order], edges[:-1]), np.diff(edges))
        spread = np.empty(len(keys), np.int64)
        spread[order] = total
        shared = np.flatnonzero((spread > 1) & (counts == 1))
        shared = shared[np.argsort(docs[shared], kind="stable")]
        cut_here = bounds(docs[shared])
        rows = [(int(docs[shared[a]]), keys[shared[a:b]].tobytes(), None) for a, b in zip(cut_here[:-1].tolist(), cut_here[1:].tolist(), strict=True)]
        hot = order[edges[:-1]]
        hot = hot[spread[hot] > hot_from]
        if len(hot):
            rows.append((None, keys[hot].tobytes(), spread[hot].astype("<i8").tobytes()))
        if not rows:
            continue
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], schema)


def _member(documents: np.ndarray, keys: np.ndarray, lists: list) -> np.ndarray:
    """Whether each (document, key) is among the lists of bytes of its document."""
    joined = [b"".join(x for x in blobs if x) if blobs else b"" for blobs in lists]
    own = np.repeat(np.arange(len(joined)), [len(x) // 4 for x in joined]).astype(np.uint64)
    known = np.frombuffer(b"".join(joined), "<u4").astype(np.uint64)
    return np.isin(documents.astype(np.uint64) << np.uint64(32) | _short(keys), own << np.uint64(32) | known)


_STRINGS = pa.schema([("_id", pa.int64()), ("_h", pa.int64()), ("starts", pa.binary()), ("column", pa.int16()), ("data", pa.binary())])


def _packed(ids: np.ndarray, hashes: np.ndarray, starts: list[bytes], columns: np.ndarray, data: list[bytes]) -> bytes:
    """Strings of one bucket as a compressed Arrow stream: less to shuffle, and one row instead of hundreds."""
    sink = pa.BufferOutputStream()
    arrays = [pa.array(x, f.type) for x, f in zip((ids, hashes, starts, columns.astype(np.int16), data), _STRINGS, strict=True)]
    with pa.ipc.new_stream(sink, _STRINGS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=_STRINGS))
    return sink.getvalue().to_pybytes()


def _strings(size: int, frequent: np.ndarray, buckets: int):
    """Strings of the shared minimizers for the construction, packed per bucket, and spans that the batch alone decides.

    Of equal strings in a batch only that of its smallest document goes on, with all its places there: the others
    repeat that document.
    """
    names = ["bucket", "_id", "_h", "strings", "spans"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def rows(bucket, ids, hashes, strings, spans) -> pa.RecordBatch:
        n = len(bucket)
        columns = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip((bucket, ids, hashes, strings, spans), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "_text", BATCH_BYTES):
                copies = some.filter(pc.fill_null(some.column("_copy"), False))
                if copies.num_rows:  # a smaller document has the same text
                    whole = [np.array([0, n], "<i4").tobytes() for n in pc.binary_length(copies.column("_text")).to_pylist()]
                    yield rows(_mix(copies.column("_h").to_numpy().view(np.uint64)).view(np.int64) % buckets, copies.column("_id"), copies.column("_h"), None, whole)
                some = some.filter(pc.invert(pc.fill_null(some.column("_copy"), False)))
                data, ends = binary_rows(some.column("_text"))
                data, ends = data[ends[0] : ends[-1]], ends - ends[0]
                (document, first, count, place), grams = minimizers(data, ends, size)
                if not len(document):
                    continue
                keys = grams[place]
                shared = _member(document, keys, some.column("_keys").to_pylist())
                hot = np.isin(_short(keys), frequent)
                document, first, count, place, keys, hot = (x[shared] for x in (document, first, count, place, keys, hot))
                column = first - (place - (size - GRAM))
                if hot.any():
                    times = np.where(hot, count, 1)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    document, first, count, keys, column, hot = (np.repeat(x, times) for x in (document, first, count, keys, column, hot))
                    first = np.where(hot, first + nth, first)
                    count, column = np.where(hot, 1, count), np.where(hot, 0, column)
                if not len(document):
                    continue
                prints = _mix(rolling(data, size))
                keys = np.where(hot, prints[first], keys)
                ids = pc.fill_null(some.column("_id"), 0).to_numpy()[document]
                hashes = some.column("_h").to_numpy()[document]
                head, tail = prints[first], prints[first + count - 1]
                order = np.lexsort((first, hashes, ids, tail, head, count))
                edges = bounds(count[order], head[order], tail[order])
                smallest = np.repeat(ids[order][edges[:-1]], np.diff(edges))
                repeated = order[ids[order] > smallest]
                kept = order[ids[order] == smallest]
                start = (first - ends[document]).astype("<i4")
                same = bounds(count[kept], head[kept], tail[kept], ids[kept], hashes[kept])
                starts = [start[kept[a:b]].tobytes() for a, b in zip(same[:-1].tolist(), same[1:].tolist(), strict=True)]
                kept = kept[same[:-1]]
                bucket = (keys[kept] % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cut = bounds(bucket[by])
                packed = []
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    own = by[a:b]
                    k = kept[own]
                    packed.append(_packed(ids[k], hashes[k], [starts[x] for x in own], column[k], [data[x:y].tobytes() for x, y in zip(first[k].tolist(), (first + count + size - 1)[k].tolist(), strict=True)]))
                yield rows(bucket[by][cut[:-1]], None, None, packed, None)
                if len(repeated):
                    doc, h, spans = _per_document(ids[repeated], hashes[repeated], start[repeated], (start + count - 1 + size)[repeated])
                    yield rows(_mix(h.view(np.uint64) ^ _mix(doc.view(np.uint64))).view(np.int64) % buckets, doc, h, None, spans)

    return run


def _decide(size: int):
    """Spans of each document whose bytes also start in a smaller one, from whole collections of strings."""
    names = ["_id", "_h", "spans"]
    width = 2 * size - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"]):
            local = table.filter(pc.is_valid(table.column("spans")))
            if local.num_rows:
                yield from local.select(names).combine_chunks().to_batches()
            table = table.filter(pc.is_valid(table.column("strings")))
            edges = bounds(table.column("bucket").to_numpy())
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield from decided(pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("strings").slice(lo, hi - lo)]).combine_chunks())

    def decided(table: pa.Table) -> Iterator[pa.RecordBatch]:
        data, ends = binary_rows(table.column("data").chunk(0))
        lengths = np.diff(ends)
        ids, h, column = (table.column(c).to_numpy() for c in ("_id", "_h", "column"))
        blobs = table.column("starts").to_pylist()
        starts, times = np.frombuffer(b"".join(blobs), "<i4"), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        symbols = np.zeros((len(ids), width), np.int16)
        row = np.repeat(np.arange(len(ids)), lengths)
        at = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], lengths) + np.repeat(column, lengths)
        symbols[row, at] = data[ends[0] : ends[-1]].astype(np.int16) + 1
        least = least_owner(symbols, ids, size)
        row, first, last = _spans(least < ids[:, None], size)
        if len(row):
            k = times[row]  # a string that stands at several places of its document is decided once
            at = np.repeat(np.arange(len(row)), k)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
            row, first, last = row[at], first[at], last[at]
            shift = starts[(np.cumsum(times) - times)[row] + nth] - column[row]
            doc, hh, spans = _per_document(ids[row], h[row], first + shift, last + shift)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(hh), pa.array(spans, pa.binary())], names)

    return run


def merged(blobs: list[bytes] | None) -> np.ndarray:
    """Maximal runs of the union of spans given as pairs of 32-bit numbers."""
    pairs = np.frombuffer(b"".join(blobs or []), "<i4").reshape(-1, 2)
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    starts = np.flatnonzero(new)
    return np.stack([pairs[starts, 0], reach[np.append(starts[1:], len(pairs)) - 1]], axis=1)


def whole_characters(text: bytes, runs: np.ndarray) -> np.ndarray:
    """Runs of UTF-8 bytes without the characters that they hold in part."""
    inside = np.append((np.frombuffer(text, np.uint8) & 0xC0) == 0x80, False)
    runs = runs.copy()
    while (k := inside[runs[:, 0]]).any():
        runs[k, 0] += 1
    while (k := inside[runs[:, 1]]).any():
        runs[k, 1] -= 1
    return runs[runs[:, 0] < runs[:, 1]]


def _cut(characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut_batch(batch, characters)

    return run


def _cut_batch(batch: pa.RecordBatch, characters: bool) -> Iterator[pa.RecordBatch]:
    for some in slices(batch, "_text"):
        firsts, lasts, kept = [], [], []
        for text, h, found in zip(some.column("_text").to_pylist(), some.column("_h").to_pylist(), some.column("_spans").to_pylist(), strict=True):
            runs = merged([x["spans"] for x in found or [] if x["_h"] == h])
            if characters:
                runs = whole_characters(text, runs)
            edges = [0, *runs.ravel().tolist(), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            firsts.append(runs[:, 0])
            lasts.append(runs[:, 1])
        ends = pa.array(np.cumsum([0, *map(len, firsts)]).astype(np.int32))
        pair = pa.StructArray.from_arrays([pa.array(np.concatenate(firsts).astype(np.int32)), pa.array(np.concatenate(lasts).astype(np.int32))], ["first", "last"])
        yield pa.RecordBatch.from_arrays([some.column("_id"), some.column("_text"), pa.ListArray.from_arrays(ends, pair), pa.array(kept, pa.binary())], ["_id", "_text", "spans", "kept"])


def _frequent(answered: DataFrame, hot_from: int) -> np.ndarray:
    """Minimizers in more than ``hot_from`` documents, at most ``MOST_HOT`` of them: the threshold rises until they fit."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, "<u4").astype(np.int64)), pa.array(np.frombuffer(counts, "<i8"))], ["key", "n"])

    found = answered.where("_id IS NULL").select("keys", "counts").mapInArrow(tidied(unpack), "key long, n long")
    limit = hot_from
    while len(rows := found.where(F.col("n") > limit).limit(MOST_HOT + 1).toPandas()) > MOST_HOT:
        limit *= 2
    return rows["key"].to_numpy(np.int64).astype("<u4")


def repeated_spans(rows: DataFrame, id: str = "doc_id", text: str = "text", size: int = 50, characters: bool = False, hot: int = HOT) -> DataFrame:
    """``id``, ``text`` (binary), ``spans`` (first byte, end) and ``kept`` (binary) of every row.

    A byte is in a span if a string of ``size`` bytes that covers it also starts in a row with a smaller id. Null
    texts count as empty; a row with a null id is compared with nothing and keeps all its bytes. Rows that share an
    id do not count as smaller than one another. Matches never cross rows. Minimizers are first asked for how many
    rows have them, in compact blocks of hashes, so only strings with a shared minimizer are shuffled.
    With ``characters``, spans leave a character whole that they would cut, so that ``kept`` stays valid UTF-8.
    """
    if size <= GRAM:
        raise ValueError(f"size must be above {GRAM}")
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    docs = rows.select(F.col(id).cast("long").alias("_id"), F.xxhash64(body).alias("_h"), body.alias("_text"))
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // (16 << 20))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (64 << 20))
    asked = docs.where(F.col("_id").isNotNull() & (F.length("_text") >= size)).select("_id", "_text").mapInArrow(tidied(_asks(size, buckets)), "bucket long, keys binary, docs binary, runs binary, several binary")
    answered = stored(asked.repartition(min(parts, 2 * buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_answers(hot)), "_id long, keys binary, counts binary"), "minimizers")
    del asked
    swept(rows.sparkSession)  # the questions' shuffle files go before the strings are shuffled
    keys = answered.where("_id IS NOT NULL").groupBy("_id").agg(F.collect_list("keys").alias("_keys")).withColumn("_same", F.lit(None).cast("array<bigint>"))
    # copies of a whole text need no strings: all but the first are covered from end to end
    prints = docs.where(F.col("_id").isNotNull() & (F.length("_text") >= size)).select("_id", "_h", F.xxhash64(F.lit(1), "_text").alias("_h2"), F.length("_text").alias("_n"))
    prints = stored(prints, "prints")
    firsts = prints.groupBy("_h", "_h2", "_n").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    copies = prints.join(firsts, ["_h", "_h2", "_n"]).where("_id > _first").groupBy("_id").agg(F.collect_set("_h").alias("_same"))
    known = keys.unionByName(copies.withColumn("_keys", F.lit(None).cast("array<binary>"))).groupBy("_id").agg(F.first("_keys", True).alias("_keys"), F.first("_same", True).alias("_same"))
    marked = docs.join(known, "_id", "left").select("_id", "_h", "_keys", F.array_contains("_same", F.col("_h")).alias("_copy"), "_text")
    marked = marked.withColumn("_text", F.when(F.col("_keys").isNotNull() | F.col("_copy"), F.col("_text")))
    packs = max(parts, total // (4 << 20))
    strings = marked.mapInArrow(tidied(_strings(size, _frequent(answered, hot), packs)), "bucket long, _id long, _h long, strings binary, spans binary")
    decided = strings.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_decide(size)), "_id long, _h long, spans binary")
    spans = decided.groupBy("_id").agg(F.collect_list(F.struct("_h", "spans")).alias("_spans"))
    joined = docs.join(spans, "_id", "left").select("_id", "_h", "_text", "_spans")
    cut = joined.mapInArrow(tidied(_cut(characters)), "_id long, _text binary, spans array<struct<first: int, last: int>>, kept binary")
    return cut.select(F.col("_id").alias(id), F.col("_text").alias(text), "spans", "kept")
