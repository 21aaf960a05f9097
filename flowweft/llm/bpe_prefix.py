"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Merging by rank gives every prefix of a piece one last token, and the tokens before it are those of the shorter prefix:
a row of tokens is an encoding exactly if every two neighbours are. So one pass over a piece suffices. An automaton of
the vocabulary names the tokens that end at a place; the one that may follow the last token of the prefix before it is
stored for the place, and going back from the end gives the ids.

Two tokens may be neighbours if merging their joined bytes makes no merge across their border. That follows from the
tokens' edges: the right edge of the first is, at any time of the merging, one of the tokens that it was made of, and the
left edge of the second likewise.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .encode import cut_pieces, piece_text

_NEVER = 1 << 60


def _alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PrefixEncoder:
    """A byte-level vocabulary with its merges, as the tokenizer's file has them.

    ``remember`` pieces, ``longest`` characters each at most, and as many pairs of tokens are kept; the memory starts anew when it is full.
    """

    def __init__(self, path: str, remember: int = 300_000, longest: int = 64):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges") if model.get(k)]
        cuts = stored.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or odd or stored.get("normalizer") or cuts.get("type") != "ByteLevel" or cuts.get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE {odd}")
        self.vocabulary: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Ranks are times: a token that a merge makes is there from that merge on, a byte from the start.
        self.joined = {(self.vocabulary[a], self.vocabulary[b]): t for t, (a, b) in enumerate(merges)}
        self.made: dict[int, tuple[int, int, int]] = {}
        for t, (a, b) in enumerate(merges):
            self.made.setdefault(self.vocabulary[a + b], (t, self.vocabulary[a], self.vocabulary[b]))
        if len(self.made) != len(merges):
            raise ValueError(f"{path} makes a token by two merges")
        self.letters = _alphabet()
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocabulary.items():
            if len(token) == 1 or i in self.made:
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        # Only the rules for cutting a text into pieces are the library's; no model of it is used.
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.added = {t["content"]: t["id"] for t in stored.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in stored.get("added_tokens", [])):
            raise ValueError(f"{path} has added tokens that look at their neighbours")
        self.split_added = re.compile("|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))) if self.added else None
        codes = {c: b for b, c in self.letters.items()}
        self.bytes_of = {i: bytes(map(codes.__getitem__, t)) for t, i in self.vocabulary.items() if all(c in codes for c in t)}
        self.bytes_of |= {i: c.encode() for c, i in self.added.items()}
        self.remember, self.longest = remember, longest
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        # Right and left edges of a token: (time from which it is one, time at which the next larger one takes it).
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}

    def _edges(self, token: int, side: int) -> list[tuple[int, int]]:
        """(edge token, time at which it is merged into a larger one) from the token itself down to a byte."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            until, token = self.made[token][0], self.made[token][side]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether the bytes of both tokens, merged together, give just these two tokens."""
        known = self.pairs.get((first, second))
        if known is None:
            if len(self.pairs) >= self.remember:
                self.pairs.clear()
            known = self.pairs[first, second] = self._apart(first, second)
        return known

    def _apart(self, first: int, second: int) -> bool:
        """No edge of the first ever stands beside an edge of the second that it merges with.

        Both sides are gone through from bytes up, always the one whose edge is taken sooner. Of two merges of one rank
        the one further left comes first: inside the first token before one across the border, which comes before one
        inside the second.
        """
        for edges, token, side in ((self.right, first, 2), (self.left, second, 1)):
            if token not in edges:
                if len(edges) >= self.remember:
                    edges.clear()
                edges[token] = self._edges(token, side)
        right, left = self.right[first], self.left[second]
        i, j = len(right) - 1, len(left) - 1
        while True:
            (a, until_a), (b, until_b) = right[i], left[j]
            t = self.joined.get((a, b), _NEVER)
            if t < until_a and t <= until_b and t != _NEVER:
                return False
            if until_a == until_b == _NEVER:
                return True
            if until_a <= until_b:
                i -= 1
            else:
                j -= 1

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, written in the vocabulary's alphabet."""
        last, steps = [0] * len(piece), [0] * len(piece)
        for end, (token, size) in self.automaton.iter(piece):
            before = end - size
            if not steps[end] and (before < 0 or steps[before] and self.may_follow(last[before], token)):
                last[end], steps[end] = token, size
        out, at = [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= steps[at]
        out.reverse()
        return out

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        ids = array("I")
        for piece, _ in self.cutter.pre_tokenize_str(text):
            ids.extend(self.encode_piece(piece))
        return ids.tobytes()

    def _missing(self, key: str) -> bytes:
        found = self._plain(piece_text(key))
        if len(key) <= self.longest:
            if len(self.pieces) >= self.remember:
                self.pieces.clear()
            self.pieces[key] = found
        return found

    def _segment(self, text: str) -> bytes:
        keys = cut_pieces(text) if text else []
        if keys is None:
            return self._plain(text)
        known = self.pieces.get
        return b"".join([known(k) or self._missing(k) for k in keys])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null counts as empty."""
        text = text or ""
        if not self.split_added or not any(map(text.__contains__, self.added)):
            return self._segment(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [self._segment(text[at:m.start()]), array("I", [self.added[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._segment(text[at:])])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids. Bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, PrefixEncoder] = {}


def prefix_encoder(path: str) -> PrefixEncoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = PrefixEncoder(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every row; a null text counts as empty.

    Repeated rows and ids stay rows of their own; other columns are not read.
    """

    @F.pandas_udf("n_tokens long, ids binary")
    def encode(texts: pd.Series) -> pd.DataFrame:
        raw = list(map(prefix_encoder(tokenizer).encode, texts))
        return pd.DataFrame({"n_tokens": [len(r) // 4 for r in raw], "ids": raw})

    return docs.select("doc_id", encode("text").alias("e")).select("doc_id", "e.*")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``; null for null."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        one = prefix_encoder(tokenizer)
        return pd.Series([None if r is None else one.decode(np.frombuffer(r, "<u4").tolist()) for r in raw], dtype=object)

    return encoded.withColumn("decoded", decode("ids"))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of each text's ids and of what they decode to.

    Both ways in one pass, so neither ids nor decoded texts leave the worker.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = prefix_encoder(tokenizer)
        for texts in batches:
            rows = []
            for text in texts:
                raw = one.encode(text)
                back = one.decode(np.frombuffer(raw, "<u4").tolist())
                rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests("text").alias("d")).select("doc_id", "d.*")
