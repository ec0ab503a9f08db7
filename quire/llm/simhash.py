"""SimHash near-duplicates found by pigeonring filtering, and completed by a prefix filter where sets of shingles decide."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounds, chained, components, dropped, in_blocks, sifted, slices, spanning, stored, swept, tidied, union_find, whole_groups

#: Seed of the shingle hash.
SEED = 42
#: Shingles whose bits are counted at a time.
STEP = 1 << 14
#: Rows from which common shingles are estimated; the estimate decides the order of shingles, never a result.
SAMPLE = 4000
#: Most shingles with an estimate; all others count as rare.
MOST_COMMON = 1 << 18
#: Bits of the parity maps that bound the overlap of two sets, at least; sets with more members have longer maps.
MAP_BITS = 2048
#: Bits of a key beyond those that number the rows: one row in 2 ** SPARE meets another by chance, however many there are.
SPARE = 12
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the runs of ``words`` words, repeats included; of the whole sequence where it has fewer."""
    from xxhash import xxh64_intdigest

    found = text.translate(_LOWER).split()  # at bytes 0x20 and 0x09 to 0x0D, nothing else
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    stops = ends[min(words, len(found)) - 1 :][:n]
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, n)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes of a hash, for fingerprints of more than 64 bits (the finaliser of SplitMix64)."""
    if not k:
        return h
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, words: int, bits: int = 64) -> bytes:
    """Big-endian fingerprint: a bit is 1 if it is set in over half the shingle hashes; zero without shingles."""
    return _majority(shingle_hashes(text, words), bits)


def _majority(h: np.ndarray, bits: int) -> bytes:
    out = []
    for k in range(bits // 64):
        counts = np.zeros(64, np.int64)
        for lo in range(0, len(h), STEP):
            part = _mixed(h[lo : lo + STEP], k).astype(">u8")
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * counts > len(h)).tobytes())
    return b"".join(out)


def fingerprints(rows: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, bits: int = 64) -> DataFrame:
    """``id`` and ``fingerprint`` (binary, ``bits`` / 8 bytes) of every whole text; a null text counts as empty."""
    if bits % 64:
        raise ValueError("bits must be a multiple of 64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "_text"):
                made = [fingerprint(t or b"", words, bits) for t in some.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(made, pa.binary())], ["id", "fingerprint"])

    return rows.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("_text")).mapInArrow(run, "id long, fingerprint binary")


def prefix_size(n: int, threshold: float) -> int:
    """Members of a set of ``n``, the first in any order common to all sets, of which one must be shared with the first
    members of every set that is ``threshold`` similar."""
    return n - int(np.ceil(threshold * n - 1e-9)) + 1 if n else 0


def parity_map(unique: np.ndarray) -> bytes:
    """``MAP_BITS`` bits or, by doubling, at least one for each member, each the parity of the members that fall on it; two maps of one
    length differ in no more bits than the sets in members. A map's halves give the map of half the length by exclusive or."""
    bits = max(MAP_BITS, 1 << (len(unique) - 1).bit_length())
    counts = np.bincount((_mixed(unique, 2) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def map_distances(maps: list[bytes], a: np.ndarray, b: np.ndarray, at_once: int = 1 << 21) -> np.ndarray:
    """Bits in which the maps at ``a`` and ``b`` differ, the longer map of a pair folded to the length of the other."""
    words = np.frombuffer(b"".join(maps), np.uint64)
    size = np.fromiter(map(len, maps), np.int64, len(maps)) // 8
    first = np.cumsum(size) - size
    out = np.zeros(len(a), np.int64)
    for x, y in np.unique(np.stack([size[a], size[b]], axis=1), axis=0).tolist():
        which = np.flatnonzero((size[a] == x) & (size[b] == y))
        step = max(1, at_once // max(x, y))
        for lo in range(0, len(which), step):
            some = which[lo : lo + step]
            own = [np.bitwise_xor.reduce(words[first[k[some], None] + np.arange(n)].reshape(len(some), -1, min(x, y)), axis=1) for k, n in ((a, x), (b, y))]
            out[some] = np.bitwise_count(own[0] ^ own[1]).sum(axis=1, dtype=np.int64)
    return out


def common_shingles(rows: DataFrame, id: str, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that at least three of about ``SAMPLE`` rows hold, and in how many."""
    every = max(1, rows.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "_text", 1 << 20):
                found = [np.unique(shingle_hashes(t or b"", words)) for t in some.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    some = rows.where(F.col(id).isNotNull() & (F.pmod(F.xxhash64(F.col(id), F.lit(11)), F.lit(every)) == 0)).select(F.col(text).cast("binary").alias("_text"))
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    h, n = np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def described(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], id: str, text: str, words: int, bits: int, threshold: float) -> DataFrame:
    """``id``, ``fingerprint``, and of the set of shingles: a 128-bit hash (``shingles``), the size (``n``), the members of its
    prefix from the rarest on (``prefix``) and its parity map (``map``)."""
    hashes, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "_text"):
                prints, names, sizes, prefixes, maps = [], [], [], [], []
                for t in some.column("_text").to_pylist():
                    h = shingle_hashes(t or b"", words)
                    unique = np.unique(h)
                    rank = np.zeros(len(unique), np.int64)
                    if len(hashes):
                        at = np.minimum(np.searchsorted(hashes, unique), len(hashes) - 1)
                        rank = np.where(hashes[at] == unique, counts[at], 0)
                    prints.append(_majority(h, bits))
                    names.append(blake2b(unique.astype("<u8").tobytes(), digest_size=16).digest())
                    sizes.append(len(unique))
                    prefixes.append(unique[np.lexsort((unique, rank))[: prefix_size(len(unique), threshold)]])
                    maps.append(parity_map(unique))
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes).view(np.int64)))
                columns = [some.column("id"), pa.array(prints, pa.binary()), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), prefix, pa.array(maps, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "fingerprint", "shingles", "n", "prefix", "map"])

    schema = "id long, fingerprint binary, shingles binary, n int, prefix array<bigint>, map binary"
    return rows.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("_text")).mapInArrow(tidied(run), schema)


def segments(bits: int, m: int) -> list[tuple[int, int]]:
    """First bit and end of each of m segments of about equal size."""
    edges = [round(i * bits / m) for i in range(m + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _words(fingerprints: np.ndarray) -> np.ndarray:
    """Bytes of n fingerprints as n rows of 64-bit words."""
    return fingerprints.view(">u8").astype(np.uint64)


def _masks(bits: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros((len(ranges), bits), np.uint8)
    for k, (a, b) in enumerate(ranges):
        out[k, a:b] = 1
    return _words(np.packbits(out, axis=1))


def reordered(fps: np.ndarray, bits: int, ring: int) -> np.ndarray:
    """Fingerprints with their bits in another, fixed order; ring 0 keeps theirs."""
    if not ring:
        return fps
    order = np.random.default_rng(ring).permutation(bits)
    return np.ascontiguousarray(np.packbits(np.unpackbits(fps, axis=1)[:, order], axis=1))


def key_bits(n: int) -> int:
    """Bits that keys of ``n`` rows need so that the share of rows that meet by chance does not grow with ``n``."""
    return max(n - 1, 0).bit_length() + SPARE


def ring_keys(fps: np.ndarray, bits: int, m: int, chain: int, halves: bool, rings: int = 1, least: int = 0) -> np.ndarray:
    """One key for each start on the ring (twice as many with ``halves``): 64-bit hashes of the bits that must agree.

    Further ``rings`` lay the same bits out in other orders, for distances at which no chain is certain to agree.

    A pair within the distance has a start from which every chain of consecutive segments stays within its
    proportional budget, so the first segments of that chain, whose budget is below one, agree entirely. With
    ``halves``, the next segment may differ in one bit, so one of its halves agrees as well. Keys of fewer than ``least`` bits
    take in the bits that follow, which asks more than the budgets do.
    """
    parts = segments(bits, m)
    ranges: list[list[tuple[int, int]]] = []
    for start in range(m):
        whole = [parts[(start + k) % m] for k in range(chain)]
        short, at = min(least, bits) - sum(b - a for a, b in whole), start + chain
        while short > 0:
            a, b = parts[at % m]
            whole.append((a, min(b, a + short)))
            short, at = short - (b - a), at + 1
        a, b = parts[(start + chain) % m]
        ranges += [[*whole, (a, (a + b) // 2)], [*whole, ((a + b) // 2, b)]] if halves else [whole]
    keys = np.zeros((len(fps), rings * len(ranges)), np.uint64)
    for k in range(keys.shape[1]):
        if k % len(ranges) == 0:
            words = _words(reordered(fps, bits, k // len(ranges)))
        mask = np.bitwise_or.reduce(_masks(bits, ranges[k % len(ranges)]), axis=0)
        key = np.full(len(fps), _mixed(np.full(1, k + 1, np.uint64), 1)[0])  # apart from all keys of other starts and rings
        for w in np.flatnonzero(mask):
            key = _mixed(key ^ (words[:, w] & mask[w]), 1)
        keys[:, k] = key
    return keys.view(np.int64)


def within(x: np.ndarray, y: np.ndarray, bits: int, m: int, tau: int) -> np.ndarray:
    """Whether pairs of fingerprints differ in at most ``tau`` bits; the pigeonring filter comes first.

    Distances of the segments are laid out on the ring. A pair stays if from some start each chain of l
    consecutive segments differs in at most floor(l * tau / m) bits; only then are all bits compared.
    """
    keep = np.zeros(len(x), bool)
    difference = x ^ y
    masks = _masks(bits, segments(bits, m))
    by_segment = np.stack([np.bitwise_count(difference & mask).sum(axis=1, dtype=np.int16) for mask in masks], axis=1)
    ring = np.concatenate([by_segment, by_segment], axis=1).cumsum(axis=1)
    ring = np.concatenate([np.zeros((len(x), 1), ring.dtype), ring], axis=1)
    for start in range(m):
        left = np.flatnonzero(~keep)
        for length in range(1, m + 1):
            left = left[ring[left, start + length] - ring[left, start] <= length * tau // m]
            if not len(left):
                break
        keep[left] = True
    passed = np.flatnonzero(keep)
    keep[passed] = np.bitwise_count(difference[passed]).sum(axis=1, dtype=np.int64) <= tau
    return keep


def _links(bits: int, ring: int, tau: int, nearest: bool, most_pairs: int = 1 << 16):
    """Links of each block pair, thinned to chains that connect the same fingerprints; or, for links that are checked
    later, to a spanning forest of the nearest pairs, which connects what any threshold on the distance connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "_i", "_j"]):
            key, i, j, own, id = (table.column(c).to_numpy() for c in ("key", "_i", "_j", "_own", "id"))
            fps = np.frombuffer(b"".join(table.column("fingerprint").to_pylist()), np.uint8).reshape(len(id), bits // 8)
            words = _words(fps)
            edges = bounds(key, i, j)
            sizes = np.diff(edges)
            found_a, found_b = [], []

            def compare(a: np.ndarray, b: np.ndarray) -> None:
                ok = np.zeros(len(a), bool)
                for lo in range(0, len(a), most_pairs):
                    ok[lo : lo + most_pairs] = within(words[a[lo : lo + most_pairs]], words[b[lo : lo + most_pairs]], bits, ring, tau)
                found_a.append(a[ok])
                found_b.append(b[ok])

            for size in np.unique(sizes[sizes > 1]):
                starts = edges[:-1][sizes == size]
                x, y = np.triu_indices(size, 1)
                at_once = max(1, most_pairs // len(x))
                for lo in range(0, len(starts), at_once):
                    base = starts[lo : lo + at_once, None]
                    a, b = (base + x).ravel(), (base + y).ravel()
                    cross = (i[a] == j[a]) | (own[a] != own[b])  # pairs of one block are compared in its own task
                    compare(a[cross], b[cross])
            a, b = np.concatenate([*found_a, np.zeros(0, int)]), np.concatenate([*found_b, np.zeros(0, int)])
            nodes, index = np.unique(id[np.concatenate([a, b])], return_inverse=True)
            roots = union_find(len(nodes), index.reshape(2, -1).T) if len(a) and not nearest else np.zeros(len(nodes), int)
            x, y = chained(nodes, roots) if len(a) else (nodes, nodes)
            if nearest and len(a):
                ends = np.sort(index.reshape(2, -1).T, axis=1)
                far = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
                order = np.lexsort((ends[:, 1], ends[:, 0], far))
                tree = spanning(len(nodes), ends[order], far[order])
                y, x = nodes[ends[order][tree]].T
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64))], ["a", "b"])

    return run


def _crossing(threshold: float, most_pairs: int = 1 << 16):
    """Pairs of each block pair that lie in different components and may have the similarity: bounded by the sizes, by the
    places of the shared member and by the parity maps. The bound of the places holds at the first member that a pair
    shares, and every similar pair meets there; all bounds are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "_i", "_j"]):
            key, i, j, own, id, component, n, place = (table.column(c).to_numpy() for c in ("key", "_i", "_j", "_own", "id", "component", "n", "place"))
            maps = table.column("map").to_pylist()
            edges = bounds(key, i, j)
            sizes = np.diff(edges)
            found = [np.zeros((0, 2), np.int64)]
            for size in np.unique(sizes[sizes > 1]):
                starts = edges[:-1][sizes == size]
                x, y = np.triu_indices(size, 1)
                at_once = max(1, most_pairs // len(x))
                for lo in range(0, len(starts), at_once):
                    base = starts[lo : lo + at_once, None]
                    a, b = (base + x).ravel(), (base + y).ravel()
                    total = n[a].astype(np.int64) + n[b]
                    need = np.ceil(threshold / (1 + threshold) * total - 1e-9).astype(np.int64)
                    ok = (component[a] != component[b]) & ((i[a] == j[a]) | (own[a] != own[b]))
                    ok &= np.minimum(n[a] - place[a], n[b] - place[b]) >= need
                    a, b, total, need = (v[ok] for v in (a, b, total, need))
                    near = map_distances(maps, a, b) <= total - 2 * need
                    found.append(np.stack([id[a[near]], id[b[near]]], axis=1))
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def crossing(sets: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (``a``, ``b``) of sets in different components, among them all of the given similarity.

    ``sets`` has ``id``, ``component``, ``n``, ``prefix`` and ``map``. Similar sets share a member of their prefixes, which are
    ordered from the rarest member on, so that what many texts hold is asked of few. A member whose sets all lie in
    one component is left out; the others are compared in bounded blocks.
    """
    keyed = sets.select("id", "component", F.posexplode("prefix").alias("place", "key"))
    met = stored(in_blocks(keyed, ["key"], "id", differing="component"), "met")
    swept(sets.sparkSession)  # all members were shuffled, of which few met
    dealt = met.join(sets.select("id", "component", "n", "map"), "id").repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "id")
    pairs = dealt.select("key", "_i", "_j", "_own", "id", "component", "n", "place", "map").mapInArrow(tidied(_crossing(threshold)), "a long, b long")
    found = stored(pairs.distinct(), "crossing")
    dropped(met)
    return found


def similar(links: DataFrame, rows: DataFrame, threshold: float, id: str, text: str, words: int) -> DataFrame:
    """Links (``a``, ``b``) whose rows share at least ``threshold`` of the union of their shingles.

    Only rows with links are hashed and, but for a few that ``sifted`` lets through, shuffled. Sets hold 64-bit hashes of the shingles.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "_text"):
                sets = [np.unique(shingle_hashes(t or b"", words)) for t in some.column("_text").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "set"])

    links = stored(links, "candidates")
    needed = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    needed = stored(needed, "needed")
    texts = sifted(rows.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("_text")), "id", needed).join(needed, "id", "left_semi")
    sets = stored(texts.dropDuplicates(["id"]).mapInArrow(tidied(hashed), "id long, set array<bigint>"), "shingles")
    first = links.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    paired = first.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").withColumn("_both", F.size(F.array_intersect("sa", "sb")))
    found = stored(paired.where(F.col("_both") >= threshold * (F.size("sa") + F.size("sb") - F.col("_both"))).select("a", "b"), "similar")
    dropped(links, needed, sets)
    return found


def near_duplicates(rows: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, bits: int = 64, tau: int = 4, m: int = 5, chain: int = 1, halves: bool = True, rings: int = 1, ring: int | None = None, similarity: float | None = None) -> DataFrame:
    """``id``, ``fingerprint`` and ``component_id``, the smallest id that links reach, for every row.

    Fingerprints that differ in at most ``tau`` bits are linked. Equal fingerprints form a class, and only one
    row per class is compared, so copies cost nothing. Candidates share the bits that ``ring_keys`` requires; with
    chain * tau < m (and, for ``halves``, (chain + 1) * tau < 2 * m) no pair is missed. A longer chain asks more of a
    candidate than the budgets do: it finds a pair only if some chain of that length agrees entirely, in one of ``rings`` orders of the bits. With ``similarity``,
    where what they miss is completed, keys have at least ``key_bits`` bits for the number of classes. The filter before the full comparison takes
    ``ring`` segments (``m`` unless given). With ``similarity``, links stand only if the sets of shingles are that similar
    (Jaccard), whatever the fingerprints; classes are formed by equal sets of shingles, and what fingerprints did not connect
    is completed by ``crossing``, so that any two rows that similar share a component. A null text
    counts as empty; texts without words have fingerprint zero. Ids are taken to be unique; rows that share one
    share its component, and a null id is compared with nothing unless its class is another row's. Groups of any size are compared in bounded blocks.
    """
    spark = rows.sparkSession
    if halves and (chain > 1 or rings > 1):
        raise ValueError("halves go with a chain of one segment on one ring")
    if similarity is None:
        same, prints = "fingerprint", stored(fingerprints(rows, id, text, words, bits), "fingerprints")
        classes = stored(prints.where("id IS NOT NULL").groupBy("fingerprint").agg(F.min("id").alias("id")), "classes")
    else:
        if bits % 64:
            raise ValueError("bits must be a multiple of 64")
        common = common_shingles(rows, id, text, words)
        same, prints = "shingles", stored(described(rows, common, id, text, words, bits, similarity), "fingerprints")
        classes = stored(prints.where("id IS NOT NULL").groupBy("shingles").agg(F.min("id").alias("id"), F.min_by("fingerprint", "id").alias("fingerprint")), "classes")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = key_bits(classes.count()) if similarity is not None else 0

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                fps = np.frombuffer(b"".join(some.column("fingerprint").to_pylist()), np.uint8).reshape(some.num_rows, bits // 8)
                made = ring_keys(fps, bits, m, chain, halves, rings, least)
                ids = np.repeat(some.column("id").to_numpy(), made.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(made.ravel()), pa.array(ids)], ["key", "id"])

    keyed = classes.repartition(tasks).mapInArrow(keys, "key long, id long")  # cheaper to make twice than to store
    met = in_blocks(keyed, ["key"], "id").join(classes, "id")
    dealt = met.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "id")
    links = dealt.select("key", "_i", "_j", "_own", "id", "fingerprint").mapInArrow(_links(bits, ring or m, tau, similarity is not None), "a long, b long")
    if similarity is not None:
        near = similar(links.distinct(), rows, similarity, id, text, words)
        swept(spark)  # each part's shuffle files go before the next part writes its own
        known = classes.select("shingles", "id").join(components(near), "id", "left").select("shingles", "id", F.coalesce("component", "id").alias("component"))
        sets = stored(prints.join(known, ["shingles", "id"]).select("id", "component", "n", "prefix", "map"), "sets")
        whole, prints = prints, stored(prints.select("id", "fingerprint", "shingles"), "prints")
        dropped(whole)
        swept(spark)
        pairs = crossing(sets, similarity)
        dropped(sets)
        swept(spark)
        more = similar(pairs, rows, similarity, id, text, words)
        dropped(pairs)
        swept(spark)
        links = near.union(more)
    reached = components(links)
    named = classes.join(reached, "id", "left").select(same, F.coalesce("component", "id").alias("component_id"))
    found = prints.join(named, same, "left").select(F.col("id").alias(id), "fingerprint", "component_id")
    if similarity is not None:  # the sets are large: nothing but the result is kept
        found = stored(found, "duplicates")
        dropped(prints, classes, near, more)
        swept(spark)
    return found
