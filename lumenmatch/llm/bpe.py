"""Byte-level BPE by prefix dynamic programming."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable
from sys import getsizeof

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmatch.llm.arrow import fields, map_batches

#: White space as the library's pattern engine takes it (Unicode White_Space); fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Bytes (as ``sys.getsizeof`` counts, with the table's own) that a worker holds of segments in each of two generations, of
#: pieces, of tables of piece starts and of judged pairs; beyond that the older generation goes, or the others start anew.
SEGMENTS, PIECES, TABLES, PAIRS = 32 << 20, 4 << 20, 32 << 20, 40 << 20
#: What an entry costs besides its key and value, and what a judged pair costs in all.
ENTRY, PAIR = 100, 130
#: Bytes after which the table of last tokens of a piece's start is remembered, for pieces that go on from it.
STARTS = (4, 7, 10)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 text and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_tree(ranks: dict[bytes, int]) -> tuple[dict[tuple[int, int], int], dict[int, tuple[int, int]]]:
    """Merges (left, right) to token, and the halves of each token that merges reach; byte tokens are their own halves."""
    pairs: dict[tuple[int, int], int] = {}
    halves: dict[int, tuple[int, int]] = {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            halves[rank] = (rank, rank)
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2 and all(p in ranks and ranks[p] in halves for p in parts):
            pair = (ranks[parts[0]], ranks[parts[1]])
            pairs[pair] = rank
            halves[rank] = pair
    return pairs, halves


class Codec:
    """Encoder and decoder over a rank table; small enough to broadcast (its size is the vocabulary's)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs, self.halves = merge_tree(ranks)
        self.reached = {t: r for t, r in ranks.items() if r in self.halves}
        self.pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self._open()

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("ranks", "pairs", "halves", "reached", "pattern")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def _open(self) -> None:
        self.split = regex.compile(self.pattern).findall
        # no match of the pattern goes from other characters into white space, so these segments split alone
        self.segments = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[bytes, array] = {}
        self.tables: dict[bytes, array] = {}
        self.held = dict.fromkeys(("known", "pieces", "tables"), 0)
        self.spelt = dict(zip(self.ranks.values(), self.ranks))
        self.names = {rank: str(rank) for rank in self.spelt}
        # every ending of a token that merges reach, with the token that it is itself or -1
        self.ends: dict[bytes, int] = {}
        for token in self.reached:
            for i in range(len(token)):
                self.ends.setdefault(token[i:], -1)
        self.ends.update(self.reached)

    def valid(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` as they are side by side."""
        known = self.fits.get(left << 32 | right)
        if known is None:
            if len(self.fits) * PAIR > PAIRS:
                self.fits.clear()
            known = self.fits[left << 32 | right] = self._valid(left, right)
        return known

    def _hold(self, name: str, limit: int, key: str | bytes, value: array | bytes) -> None:
        """Remembers an entry; beyond ``limit`` bytes those of before go."""
        self.held[name] += getsizeof(key) + getsizeof(value) + ENTRY
        if self.held[name] > limit:
            self.held[name] = 0
            if name == "known":
                self.older, self.known = self.known, {}
            else:
                getattr(self, name).clear()
        getattr(self, name)[key] = value

    def _valid(self, left: int, right: int) -> bool:
        # undo the later of the two last merges, step by step; a merge across the border that comes before it spoils the pair
        before = 1 << 60
        while True:
            if self.pairs.get((left, right), before) < before:
                return False
            whole_left, whole_right = self.halves[left][0] == left, self.halves[right][0] == right
            if whole_left and whole_right:
                return True
            # of equal tokens the right one comes apart first: merges of one rank go from left to right
            if whole_left or (not whole_right and right >= left):
                before, right = right + 1, self.halves[right][0]
            else:
                before, left = left, self.halves[left][1]

    def prefixes(self, piece: bytes, last: Iterable[int] = ()) -> list[int]:
        """The last token of the encoding of every prefix of ``piece`` (first prefix: one byte).

        ``last`` holds known entries of an earlier string with the same start: appending bytes goes on from them, and an
        edit at byte i needs only those from i on again.
        """
        last, ends, fits = list(last), self.ends, self.fits
        for end in range(len(last) + 1, len(piece) + 1):
            start, tried = end - 1, []
            while start >= 0 and (token := ends.get(piece[start:end])) is not None:
                if token >= 0:
                    tried.append((start, token))
                start -= 1
            for start, token in reversed(tried):
                if start == 0 or (fits.get(last[start - 1] << 32 | token) or self.valid(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        at, out = len(last), []
        while at:
            out.append(last[at - 1])
            at -= len(self.spelt[last[at - 1]])
        return out[::-1]

    def piece(self, piece: bytes) -> Iterable[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        ids = self.pieces.get(piece)
        if ids is None:
            last: Iterable[int] = ()
            size = len(piece)
            for k in STARTS:
                if size < k:
                    break
                start = piece[:k]
                table = self.tables.get(start)
                if table is None:
                    table = array("i", self.prefixes(start, last))
                    self._hold("tables", TABLES, start, table)
                last = table
            ids = array("i", self.tokens(self.prefixes(piece, last)))
            if len(piece) <= 64:
                self._hold("pieces", PIECES, piece, ids)
        return ids

    def segment(self, text: str) -> bytes:
        return array("i", [t for p in self.split(text) for t in self.piece(p.encode("utf-8", "replace"))]).tobytes()

    def encode(self, text: str) -> array:
        """Ids of a text, each match of the pattern separately."""
        known, out = self.known, []
        for s in self.segments(text):
            ids = known.get(s)
            if ids is None:
                ids = self.older.get(s)
                if ids is None:
                    ids = self.segment(s)
                if len(s) <= 64:
                    self._hold("known", SEGMENTS, s, ids)
                    known = self.known
            out.append(ids)
        return array("i", b"".join(out))

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of ids."""
        return b"".join(map(self.spelt.__getitem__, ids))

    def listed(self, ids: Iterable[int]) -> str:
        """Decimal ids, joined by commas."""
        return ",".join(map(self.names.__getitem__, ids))


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) of every row's whole text.

    Defined cases: a null or empty text has no ids; repeated rows and null ids are encoded row by row; an empty table gives
    no rows. Other columns are ignored.
    """
    codec = docs.sparkSession.sparkContext.broadcast(Codec(ranks, pattern))

    def work(batch):
        encode = codec.value.encode
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield {**{k: part.column(k) for k in keep}, "ids": [encode(x or "").tolist() for x in part.column("__text").to_pylist()]}

    return map_batches(docs.select(*keep, F.col(text).alias("__text")), fields(docs, keep, "ids array<int>"), work)


def decode_ids(encoded: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the bytes that ``ids`` stand for; null ids decode to no bytes."""
    codec = encoded.sparkSession.sparkContext.broadcast(Codec(ranks, pattern))

    def work(batch):
        yield {**{k: batch.column(k) for k in keep}, "decoded": [codec.value.decode(x or ()) for x in batch.column("ids").to_pylist()]}

    return map_batches(encoded.select(*keep, "ids"), fields(encoded, keep, "decoded binary"), work)


def token_digests(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False
) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids: each text is encoded and its ids decoded
    in one pass. Cases as in ``encode_texts``."""
    codec = docs.sparkSession.sparkContext.broadcast(Codec(ranks, pattern))

    def work(batch):
        c = codec.value
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            encoded = [c.encode(x or "") for x in part.column("__text").to_pylist()]
            out = {
                **{k: part.column(k) for k in keep},
                "n_tokens": list(map(len, encoded)),
                "ids_sha256": [hashlib.sha256(c.listed(x).encode()).hexdigest() for x in encoded],
                "decoded_sha256": [hashlib.sha256(c.decode(x)).hexdigest() for x in encoded],
            }
            yield out | ({"ids": [x.tolist() for x in encoded]} if ids else {})

    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_batches(docs.select(*keep, F.col(text).alias("__text")), fields(docs, keep, added), work)
