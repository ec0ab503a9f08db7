"""Byte-level BPE by backtracking over longest matches, in linear time, and its decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices
from quire.llm.tokens import LONGEST_REMEMBERED, Chunks, read_ranks

#: Pairs of adjacent tokens whose compatibility a Python worker remembers.
PAIRS_REMEMBERED = 1 << 19
#: Matches of the splitting pattern whose ids a Python worker remembers.
PIECES_REMEMBERED = 800_000


class Backtracking:
    """Ids of one match of the splitting pattern, as repeated merging of the lowest rank yields them.

    Bytes are mapped to Latin-1, so that a trie of strings finds the tokens in them. From each position
    the longest token is tried first; it stands only if it is compatible with the token before it, that is, if
    merging would not have crossed the border between the two. Where no token fits, the previous one is shortened,
    and a position that failed is never tried again, so the work is linear in the length.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        if max(ranks.values()) >= 1 << 20:
            raise ValueError("ranks of 1,048,576 and above are not supported")
        self.ranks = ranks
        self.text = {id: token for token, id in ranks.items()}
        self.pair = {}
        self.split = {}
        for token, id in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._last_merge(token, id) if len(token) > 1 else None
            if parts:
                self.pair[parts] = id
                self.split[id] = parts
            else:
                self.split[id] = (id, id)
        # single bytes, and what merging can make: the rest of the vocabulary never stands in a result
        self.ids = {t.decode("latin-1"): id for t, id in ranks.items() if len(t) == 1 or self.split[id] != (id, id)}
        self.longest = max(map(len, self.ids))
        self.trie = ahocorasick.Automaton()
        for token, id in self.ids.items():
            self.trie.add_word(token, id)
        self.pairs: dict[int, bool] = {}

    def _last_merge(self, token: bytes, id: int) -> tuple[int, int] | None:
        """The two tokens that merging joins last to make this one; none if merging never makes it."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, k = min((ranks.get(parts[i] + parts[i + 1], id), i) for i in range(len(parts) - 1))
            if rank >= id:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if parts[0] in ranks and parts[1] in ranks else None

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens leaves a border between them."""
        bound = 1 << 62
        while True:
            if self.pair.get((left, right), bound) < bound:
                return False
            if left > right:
                bound = left
                left = self.split[left][1]
                if left == bound:
                    bound, right = right + 1, self.split[right][0]
                    if right + 1 == bound:
                        return True
            else:
                bound = right + 1
                right = self.split[right][0]
                if right + 1 == bound:
                    bound, left = left, self.split[left][1]
                    if left == bound:
                        return True

    def _remember(self, key: int) -> bool:
        if len(self.pairs) >= PAIRS_REMEMBERED:
            self.pairs.clear()
        fits = self.pairs[key] = self._compatible(key >> 20, key & 0xFFFFF)
        return fits

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, known, ids, reach, longest = len(piece), self.pairs.get, self.ids.get, self.trie.longest_prefix, self.longest
        text = piece.decode("latin-1")
        dead, found, at = bytearray(n + 1), [], 0
        size = reach(text[:longest])  # no token that begins here is longer
        while at < n:
            before = found[-1] << 20 if found else None
            while size:
                id = ids(text[at : at + size])
                if id is not None and not dead[at + size]:
                    if before is None:
                        break
                    fits = known(before | id)
                    if fits is None:
                        fits = self._remember(before | id)
                    if fits:
                        break
                size -= 1
            if size:
                found.append(id)
                at += size
                size = reach(text[at : at + longest]) if at < n else 0
            else:
                dead[at] = 1
                size = len(self.text[found.pop()])
                at -= size
                size -= 1
        return found


class Codec:
    """Encoder and decoder of a rank file for whole texts."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        pieces = regex.compile(pattern).findall
        self.merges = Backtracking(read_ranks(ranks_path))
        encode = self.merges.encode

        known: dict[str, list[int]] = {}

        def whole(data: bytes) -> list[int]:
            found: list[int] = []
            text = data.decode("utf-8")
            word = text[1:] if text[:1] == " " else text
            if word.isalpha():
                split = [text]
            elif word[:-1].isalpha() and word[-1] in ".,":
                split = [text[:-1], word[-1]]
            else:
                split = pieces(text)
            for p in split:
                ids = known.get(p)
                if ids is None:
                    ids = encode(p.encode())
                    if len(p) <= LONGEST_REMEMBERED:
                        if len(known) >= PIECES_REMEMBERED:
                            known.clear()
                        known[p] = ids
                found += ids
            return found

        self.chunks = Chunks(whole)
        self.text = [self.merges.text[i] for i in range(len(self.merges.text))]

    def encode(self, text: bytes) -> np.ndarray:
        return np.frombuffer(self.chunks.of(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.text.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """The codec of this Python worker, which it keeps for its next tasks."""
    key = (ranks_path, pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks_path, pattern)
    return _CODECS[key]


def encode_and_decode(rows: DataFrame, id: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """``ids`` (array of int) of every whole text, and ``decoded``, the bytes that decoding the ids gives.

    A null text counts as empty and has no ids. Rows with equal ids or texts are all kept; only the two named
    columns are read. No shuffle takes place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for some in slices(batch, "_text", 4 << 20):
                found = [c.encode(t or b"") for t in some.column("_text").to_pylist()]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                decoded = pa.array([c.decode(x) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(id), ids, decoded], [id, "ids", "decoded"])

    wanted = rows.select(F.col(id), F.col(text).cast("binary").alias("_text"))
    kind = wanted.schema[id].dataType.simpleString()
    return wanted.mapInArrow(run, f"`{id}` {kind}, ids array<int>, decoded binary")
