"""Byte-level BPE encoding by backtracking and decoding by an offset table.

A sequence of tokens is the encoding of its text just when every two neighbours are compatible, that is when merging
their joint bytes gives these two again. Merges happen in the order of their ranks, so two tokens are compatible unless
some token on the right edge of the left one's merge tree and some token on the left edge of the right one's, there at
the same time, merge before either is used up; the test walks the two edges back in time. The encoder takes the longest token at each place (found by an Aho-Corasick
automaton over the vocabulary), steps to shorter ones while it is incompatible with the token before, and goes back
one token where none fits, never trying a place twice. Compatibility is kept in a table of pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import batches, text_rows

#: Fixed value: how byte-level vocabularies of this family cut a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNKS_KEPT = 200_000  # chunks and pairs a task remembers before it starts anew
PAIRS_KEPT = 500_000
KEPT_LENGTH = 40  # characters


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the other
    bytes, in order, for the letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> bytes:
    """The tokenizer file, packed to travel with the plan (bounded by the vocabulary)."""
    with open(path, "rb") as file:
        return zlib.compress(file.read())


class BytePairCodec:
    def __init__(self, packed: bytes) -> None:
        spec = json.loads(zlib.decompress(packed))
        before = spec["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level vocabularies without normaliser and prefix space")
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for name, i in vocab.items():
            self.tokens[i] = name.encode() if name in self.special else bytes(letters[x] for x in name)
        for name, i in self.special.items():
            self.tokens[i] = name.encode()
        normal = {t: i for i, t in enumerate(self.tokens) if t and i not in set(self.special.values())}
        pairs = (p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = [-1] * size  # the rank of the merge that makes a token, and its two parts
        self.parts = [(-1, -1)] * size
        for pair, (rank, token) in self.merges.items():
            if self.made[token] < 0:
                self.made[token], self.parts[token] = rank, pair
        # A token must be made after its parts, else ranks are no order of time and pairs are merged out in full.
        self.timely = all(self.made[a] < self.made[token] and self.made[b] < self.made[token] for (a, b), (rank, token) in self.merges.items() if self.made[token] == rank)
        self.single = [normal[bytes([b])] for b in range(256)]
        self.length = [len(t) for t in self.tokens]
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for token, i in normal.items():
            self.shorter[i] = next((normal[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in normal), -1)
        self.automaton = ahocorasick.Automaton()
        for token, i in normal.items():
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), (i, len(token) - 1))
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECES)
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.special_head = os.path.commonprefix(list(self.special))
        self.offsets = np.concatenate(([0], np.cumsum(self.length)))
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known, self.known_before = {}, {}  # ids of pieces: the present and the last generation
        self.chunks, self.chunks_before = {}, {}

    def merged(self, data: bytes) -> list[int]:
        """Merging as defined: always the pair of lowest rank, the leftmost first."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            rank, at = min((self.merges.get(pair, (1 << 60,))[0], i) for i, pair in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        fits = self.pairs[left, right] = self.apart(left, right) if self.timely else self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return fits

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge joins the two tokens' edges. Of equal ranks the left merge comes first."""
        ranks, made, parts = self.ranks, self.made, self.parts
        left_used = right_used = 1 << 60  # when the edge token becomes part of the next one
        while True:
            rank = ranks.get((left, right))
            if rank is not None and rank < left_used and rank <= right_used:
                return False
            at_left, at_right = made[left], made[right]
            if at_left > at_right:
                left_used, left = at_left, parts[left][1]
            elif at_right >= 0:
                right_used, right = at_right, parts[right][0]
            else:
                return True

    def encode_piece(self, data: bytes) -> list[int]:
        if len(data) == 1:
            return [self.single[data[0]]]
        longest = [self.single[b] for b in data]
        for end, (token, back) in self.automaton.iter(data.decode("latin-1")):
            longest[end - back] = token  # of one start, the longer ones end later
        length, shorter, pairs = self.length, self.shorter, self.pairs
        size, token = len(data), longest[0]
        at = length[token]
        if at == size:
            return [token]
        out, dead, last, token = [token], set(), token, longest[at]
        while True:
            while token >= 0:
                end = at + length[token]
                if end not in dead:
                    fits = pairs.get((last, token))
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == size:
                    return out
                at, last, token = end, token, longest[end]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
                while not out and token >= 0 and length[token] in dead:
                    token = shorter[token]
                if not out:
                    out, at, last = [token], length[token], token
                    token = longest[at]
                else:
                    last = out[-1]

    def _chunk(self, text: str) -> tuple[int, ...]:
        if text[:1] == " " and text[1:].isalpha():  # letters after a space are one piece
            return tuple(self.encode_piece(text.encode()))
        out: list[int] = []
        if len(self.known) >= CHUNKS_KEPT // 2:
            self.known, self.known_before = {}, self.known
        known, before = self.known, self.known_before
        for i, part in enumerate(self.specials.split(text) if self.specials and self.special_head in text else [text]):
            if i % 2:
                out.append(self.special[part])
            else:
                for piece in self.pieces.findall(part):
                    ids = known.get(piece)
                    if ids is None:
                        ids = before.get(piece) or (self.chunks.get(piece[1:]) if piece[0] == " " and piece[1:].isalpha() else None) or self.encode_piece(piece.encode())
                        if len(piece) <= KEPT_LENGTH:
                            known[piece] = ids
                    out += ids
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """A single space before other text always begins a new piece, so what lies between such spaces is encoded
        by itself and remembered."""
        if not text:
            return []
        first, *rest = cut(text)
        out = [*self._chunk(first)]
        if len(self.chunks) >= CHUNKS_KEPT // 2:
            self.chunks, self.chunks_before = {}, self.chunks
        known, get, before = self.chunks, self.chunks.get, self.chunks_before.get
        for word in rest:
            ids = get(word)
            if ids is None:
                if len(known) >= CHUNKS_KEPT:
                    known.clear()
                ids = before(word) or self._chunk(" " + word)
                if len(word) <= KEPT_LENGTH:
                    known[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        at = np.asarray(ids, np.int64)
        starts = self.offsets[at]
        sizes = self.offsets[at + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(starts - ends + sizes, sizes) + np.arange(total)
        return self.bytes[places].tobytes().decode("utf-8", "replace")


def worker_codec(packed: bytes) -> BytePairCodec:
    """The codec a worker process keeps between its tasks, with what it has learnt. Functions travel by value, so it
    lies with the interpreter and not in this module."""
    kept = vars(sys).setdefault("_ravelin_codecs", {})
    key = hashlib.sha256(packed).digest()
    if key not in kept:
        kept.clear()
        kept[key] = BytePairCodec(packed)
    return kept[key]


_ODD = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def cut(text: str) -> list[str]:
    """Parts between single spaces that stand before something other than white space."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def encode(docs: DataFrame, packed: bytes) -> DataFrame:
    """``doc_id`` and ``ids`` per row of ``docs``; a null or empty text has no ids, a null ``doc_id`` stays null."""

    def run(parts):
        codec = worker_codec(packed)
        yield from batches(lambda r: [(r[0], codec.encode(r[1]))], schema, "doc_id", "text")(parts)

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return text_rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, packed: bytes) -> DataFrame:
    """``doc_id`` and the text of ``ids``; null ids decode to the empty text."""

    def run(parts):
        codec = worker_codec(packed)
        yield from batches(lambda r: [(r[0], codec.decode(r[1] or []))], schema, "doc_id", "ids")(parts)

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, packed: bytes) -> DataFrame:
    """Encodes and decodes each text in one pass: the number of ids and the digests of ids and decoded text."""

    def each(codec: BytePairCodec, row) -> list[tuple]:
        ids = codec.encode(row[1])
        told = hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        back = hashlib.sha256(codec.decode(ids).encode()).hexdigest()
        return [(row[0], len(ids), told, back)]

    def run(parts):
        codec = worker_codec(packed)
        yield from batches(lambda r: each(codec, r), schema, "doc_id", "text")(parts)

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
