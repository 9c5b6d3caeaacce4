"""Byte-level BPE: encoding and decoding with a hierarchical-bitmap rank queue.

``encode`` gives the ids that a rank file assigns to a text, each match of the
pre-token pattern on its own; ``decode`` gives the bytes back.

Merging keeps, for every merge rank, a bucket of linked-list positions whose
pair has that rank.  A two-level bitmap over the ranks names the buckets in
use, so that the next rank is found by two find-first-set steps however many
pairs wait.  A merge only writes the two pairs beside it; entries which that
makes stale stay in their buckets and are skipped when they come up.  Equal
ranks are taken in text order, and a bucket is put back as soon as a merge
gives rise to a lower rank.  A pre-token of n bytes takes O(n) queue steps, so a
megabyte without a blank is no special case.  One queue serves all new
pre-tokens of a batch, end to end, since a list never runs past a pre-token.

Defined results: null text encodes as the empty list; an empty text likewise;
null or empty id lists decode to empty bytes; an unknown id raises.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encoded pre-tokens that a Python worker remembers; beyond, the older half goes.
CACHE_ENTRIES = 500_000
#: Longer pre-tokens are not remembered.
CACHE_CHARS = 48
#: So many new pre-tokens go through one queue.
BATCH_PIECES = 4_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: base64 token, blank, rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: In texts below U+0250 these are exactly the letters, digits and white space of Unicode.
_LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}


def splitters(pattern: str):
    """(is any text beyond Latin, splitter of Latin texts, splitter of any text) for a pre-token pattern.

    The built-in engine splits Latin texts in half the time; it gets the
    pattern's classes as ranges.  ``\\s`` is White_Space in both.
    """
    import regex

    general = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    latin, inside, i = [], False, 0
    while i < len(pattern):
        token = next((k for k in (*_LATIN, r"\S") if pattern.startswith(k, i)), pattern[i : i + 2] if pattern[i] == "\\" else pattern[i])
        if token in _LATIN:
            latin.append(_LATIN[token] if inside else f"[{_LATIN[token]}]")
        elif token == r"\S":
            if inside:
                return re.compile("").search, None, general  # no range form
            latin.append(f"[^{_LATIN[chr(92) + 's']}]")
        elif token.startswith("\\") and token[1:].isalnum():
            return re.compile("").search, None, general
        else:
            inside = token == "[" or inside and token != "]"
            latin.append(token)
        i += len(token)
    return re.compile("[^\x00-\u024f]").search, re.compile("".join(latin)).findall, general


class Codec:
    """Encoder and decoder of one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        #: Bits of the low bitmap level: the square root of the rank space.
        self.bits = max(1, (len(self.tokens).bit_length() + 1) // 2)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        self.two = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.beyond, self.latin, self.general = splitters(pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.general(text) if self.beyond(text) else self.latin(text)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as packed 32-bit numbers, by one rank queue; no pre-token may be empty."""
        data = b"".join(pieces)
        n, bits, get = len(data), self.bits, self.ranks.get
        mask = (1 << bits) - 1
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        ends = np.cumsum([len(x) for x in pieces])
        first = np.full(n, -1)
        first[:-1] = self.two[raw[:-1] * 256 + raw[1:]]
        first[ends - 1] = -1
        pair = first.tolist()  # rank of the pair that begins here, -1 for none
        ids = self.byte[raw].tolist()  # id of the part that begins here
        follow = list(range(1, n + 1))  # the next part's start
        before = list(range(-1, n - 1))
        head = bytearray(n + 1)  # where pre-tokens begin
        head[0] = head[n] = 1
        for e in ends.tolist():
            head[e] = 1
        buckets: dict[int, list[int]] = {}
        low = [0] * ((len(self.tokens) >> bits) + 1)
        top = 0
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        if len(order):
            cuts = np.flatnonzero(np.diff(first[order])) + 1
            for part in np.split(order, cuts):
                r = int(first[part[0]])
                buckets[r] = part.tolist()
                low[r >> bits] |= 1 << (r & mask)
                top |= 1 << (r >> bits)
        while top:
            h = (top & -top).bit_length() - 1
            word = low[h]
            bit = word & -word
            r = h << bits | (bit.bit_length() - 1)
            bucket = buckets.pop(r)
            low[h] = word ^ bit
            if word == bit:
                top ^= 1 << h
            bucket.sort()
            for at, i in enumerate(bucket):
                if pair[i] != r:
                    continue  # stale
                ids[i] = r
                j = follow[i]
                k = follow[i] = follow[j]
                pair[j] = -1
                least = r
                if head[k]:
                    pair[i] = -1
                else:
                    before[k] = i
                    s = pair[i] = get(data[i : follow[k]], -1)
                    if s >= 0:
                        held = buckets.get(s)
                        if held is None:
                            buckets[s] = [i]
                            low[s >> bits] |= 1 << (s & mask)
                            top |= 1 << (s >> bits)
                        else:
                            held.append(i)
                        if s < least:
                            least = s
                if not head[i]:
                    p = before[i]
                    s = pair[p] = get(data[p:k], -1)
                    if s >= 0:
                        held = buckets.get(s)
                        if held is None:
                            buckets[s] = [p]
                            low[s >> bits] |= 1 << (s & mask)
                            top |= 1 << (s >> bits)
                        else:
                            held.append(p)
                        if s < least:
                            least = s
                if least < r and at + 1 < len(bucket):
                    buckets[r] = bucket[at + 1 :]
                    low[r >> bits] |= 1 << (r & mask)
                    top |= 1 << (r >> bits)
                    break
        out, cuts, i = [], [0], 0
        for e in ends.tolist():
            while i < e:
                out.append(ids[i])
                i = follow[i]
            cuts.append(4 * len(out))
        packed = np.array(out, np.int32).tobytes()
        return [packed[a:b] for a, b in pairwise(cuts)]

    def learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of all wanted pre-tokens; those that are short are remembered for later batches."""
        new = wanted - self.young.keys()
        ids = {k: self.old[k] for k in new & self.old.keys()}
        whole, rest = {}, []
        for k in new - ids.keys():
            token = self.ranks.get(k.encode())
            if token is None:
                rest.append(k)
            else:
                whole[k] = token.to_bytes(4, sys.byteorder)
        ids |= whole
        collecting = gc.isenabled()
        gc.disable()  # a merge makes many lists and no cycles
        try:
            for at in range(0, len(rest), BATCH_PIECES):
                part = rest[at : at + BATCH_PIECES]
                ids |= zip(part, self.merge([k.encode() for k in part]), strict=True)
        finally:
            if collecting:
                gc.enable()
        if len(self.young) >= CACHE_ENTRIES // 2:
            kept = {k: self.young[k] for k in wanted - new}
            self.old, self.young = self.young, kept
        long = {k: v for k, v in ids.items() if len(k) > CACHE_CHARS}
        self.young |= ids if not long else {k: v for k, v in ids.items() if k not in long}
        return long

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces(t) for t in texts]
        long = self.learn(set().union(*split))
        find = self.young.__getitem__ if not long else (self.young | long).__getitem__
        return [np.frombuffer(b"".join(map(find, x)), np.int32) for x in split]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This process's codec for a rank file; each Python worker loads the file once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    cuts = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids (array of int) of a text column.

    ``path``: rank file, at the same place on every node; ``pattern``: what
    splits a text into pre-tokens, in the syntax of the ``regex`` module, with
    ``\\s`` and ``\\S`` by Unicode's White_Space property.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for texts in batches:
            yield _lists(c.encode_all(texts.to_pylist()))

    return run(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Bytes (binary) of a column of id lists."""

    @F.arrow_udf(T.BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for lists in batches:
            yield pa.array([c.decode(x) for x in lists.to_pylist()], pa.binary())

    return run(F.coalesce(ids, F.array().cast("array<int>")))


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """``encode`` and ``decode`` of its ids in one step: a struct of ``ids`` and ``decoded``.

    The ids need not travel to a second Python worker to be decoded.
    """

    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for texts in batches:
            ids = c.encode_all(texts.to_pylist())
            yield pa.StructArray.from_arrays([_lists(ids), pa.array([c.decode(x.tolist()) for x in ids], pa.binary())], ["ids", "decoded"])

    return run(F.coalesce(text, F.lit("")))
