"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last one of the
prefix's encoding: the token t of length l for which the encoding of the first
n-l bytes ends in a token p such that the pair (p, t), encoded on its own, is
again [p, t]. A table of these last tokens is therefore enough to encode, to
append without looking back more than the longest token, to cut at any prefix,
and to encode again after an edit only until the table meets its old values.

Texts are first split by the vocabulary's pattern; merges never cross a split,
so the table starts anew at every piece. Pieces recur, so their ids are kept in
a bounded cache.
"""

from __future__ import annotations

import base64
import os
from array import array

import regex
from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Split pattern of the byte_bpe vocabularies (fixed value).
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the public vocabularies lie unless a path is given.
TOKENIZER_DIR = os.environ.get("RISKWEAVE_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCAB = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
#: Pieces kept in a worker's cache; it is emptied when full.
CACHE_PIECES = 150_000
#: Longer pieces are not kept.
CACHE_PIECE_CHARS = 64


class PrefixTable:
    """Last token and token count of every prefix of one growing byte string."""

    __slots__ = ("codec", "data", "last", "count")

    def __init__(self, codec: BytePairCodec, data: bytes = b""):
        self.codec, self.data, self.last, self.count = codec, bytearray(), [-1], [0]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Extends the string; earlier prefixes keep their entries."""
        at = len(self.data)
        self.data += data
        self._fill(at)

    def truncate(self, size: int) -> None:
        """Keeps the first `size` bytes."""
        del self.data[size:], self.last[size + 1 :], self.count[size + 1 :]

    def edit(self, start: int, removed: int, inserted: bytes) -> int:
        """Replaces bytes; returns how many prefixes were worked out again.

        After the edit the table is filled until as many neighbouring entries as the
        longest token has bytes equal the old ones; from there on the old ones hold.
        """
        old_last, old_tail = self.last[start + removed + 1 :], bytes(self.data[start + removed :])
        self.truncate(start)
        self.append(inserted)
        base, need, run, done = len(self.data), self.codec.longest, 0, len(inserted)
        self.data += old_tail
        whole = bytes(self.data)
        for i in range(len(old_tail)):
            self._fill(base + i, base + i + 1, whole)
            done += 1
            run = run + 1 if self.last[-1] == old_last[i] else 0
            if run >= need:
                rest = old_last[i + 1 :]
                lengths = self.codec.lengths
                self.last += rest
                for at in range(base + i + 2, base + len(old_tail) + 1):
                    self.count.append(self.count[at - lengths[self.last[at]]] + 1)
                break
        return done

    def _fill(self, start: int, stop: int | None = None, whole: bytes | None = None) -> None:
        codec, data, last, count = self.codec, bytes(self.data) if whole is None else whole, self.last, self.count
        find, reach, fits = codec.ranks.get, codec.reach, codec.fits
        for end in range(start + 1, (len(data) if stop is None else stop) + 1):
            most = min(end, reach.get(data[max(0, end - 2) : end], 1))
            for size in range(most, 0, -1):
                token = find(data[end - size : end])
                if token is not None and fits(last[end - size], token):
                    last.append(token)
                    count.append(count[end - size] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def ids(self, size: int | None = None) -> list[int]:
        """Encoding of the first `size` bytes (all by default)."""
        at, out, lengths = len(self.data) if size is None else size, [], self.codec.lengths
        while at:
            out.append(self.last[at])
            at -= lengths[self.last[at]]
        return out[::-1]


class BytePairCodec:
    """Encoder of one vocabulary given as ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = BYTE_BPE_PATTERN, cache_pieces: int = CACHE_PIECES):
        self.ranks = ranks
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            tail = token[-2:]
            if len(token) > self.reach.get(tail, 0):
                self.reach[tail] = len(token)
        for token in ranks:  # a two byte tail that no token has still ends in its single byte
            if len(token) == 1:
                for first in range(256):
                    self.reach.setdefault(bytes([first]) + token, 1)
        self.pieces = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.cache: dict[str, array] = {}
        self.cache_pieces = cache_pieces
        self._fit: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; used only on the few bytes of a token pair."""
        parts, find = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := find(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [find(p) for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left` (-1: the start) in an encoding."""
        key = (left + 1) << 24 | right
        if (known := self._fit.get(key)) is None:
            if left < 0:
                known = self.merged(self.tokens[right]) == [right]
            else:
                known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self._fit) > 400_000:
                self._fit.clear()
            self._fit[key] = known
        return known

    def piece_ids(self, piece: str) -> array:
        """Ids of one piece of the split."""
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        if whole is not None and self.fits(-1, whole):
            out = array("i", (whole,))
        else:
            out = array("i", PrefixTable(self, data).ids())
        if len(piece) <= CACHE_PIECE_CHARS:
            if len(self.cache) >= self.cache_pieces:
                self.cache.clear()
            self.cache[piece] = out
        return out

    def encode(self, text: str | None) -> array:
        """Ids of a text; null and empty texts have none."""
        out = array("i")
        if text:
            known, fresh = self.cache.get, self.piece_ids
            for piece in self.pieces(text):
                out += known(piece) or fresh(piece)
        return out

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        known, fresh = self.cache.get, self.piece_ids
        return sum([len(known(piece) or fresh(piece)) for piece in self.pieces(text)])

    def decode(self, ids) -> bytes:
        """Bytes of a list of ids."""
        return b"".join([self.tokens[i] for i in ids])

    def reencode(self, old_text: str, old_ids: array, text: str) -> array:
        """Ids of a text that is an edit of `old_text`, whose ids are known.

        Only the pieces that touch the edited stretch are encoded: pieces of the
        common start and end keep their ids.
        """
        old, new = self.pieces(old_text), self.pieces(text)
        head = 0
        while head < len(old) and head < len(new) and old[head] == new[head]:
            head += 1
        tail = 0
        while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
            tail += 1
        size = lambda part: sum(len(self.cache.get(p) or self.piece_ids(p)) for p in part)
        out = old_ids[: size(old[:head])]
        for piece in new[head : len(new) - tail]:
            out += self.cache.get(piece) or self.piece_ids(piece)
        if tail:
            out += old_ids[len(old_ids) - size(old[-tail:]) :]
        return out


_CODECS: dict[str, BytePairCodec] = {}
_SHIPPED: set[tuple[str, str]] = set()


def ship(spark: SparkSession, path: str) -> str:
    """Sends a rank file along with the jobs of a session whose workers may lack it, and returns its path."""
    context = spark.sparkContext
    if not context.master.startswith("local") and (context.applicationId, path) not in _SHIPPED:
        context.addFile(path)
        _SHIPPED.add((context.applicationId, path))
    return path


def codec(path: str = DEFAULT_VOCAB) -> BytePairCodec:
    """The codec of a rank file, built once in a process; the file lies at its path, or was shipped."""
    if path not in _CODECS:
        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        _CODECS[path] = BytePairCodec(ranks)
    return _CODECS[path]
