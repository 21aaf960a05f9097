"""Exact token ids of whole texts with a cache of pieces per Python worker."""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from itertools import compress, count, pairwise
from operator import not_

import numpy as np
from tokenizers import Tokenizer

# A text may be cut before white space where the character before is none: pre-tokenizers whose patterns look at white
# space only to start a token or to end a run of white space give the same tokens piece by piece. Only spaces and line
# feeds are cut at; texts with other white space are encoded in one go.
_OTHER_SPACE = ["\u180e", *[c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]]
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# Full stops and commas after a letter or digit start a token of their own, so a text may be cut there too, if all
# its stops and commas stand so (after letters that stay letters in lower case).
_LOOSE_STOP = re.compile("[.,](?<![0-9A-Za-zÀ-ÖØ-öø-įı-ſΑ-ΡΣ-Ωα-ωА-Яа-яё][.,])")
_FENCE = "\ue000"  # stands between new pieces that are encoded together


def cut_pieces(text: str) -> list[str] | None:
    """Keys of the pieces of a text that is not empty, or None if it holds white space that is not cut at.

    A piece after one space is keyed without it, one that starts with a line feed, full stop or comma as it is, any other
    after a carriage return.
    """
    if any(map(text.__contains__, _OTHER_SPACE)):
        return None
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or " ." in text or " ," in text or text[0] in " \n.," or text[-1] in " \n":
        return ["\r" + p for p in _PIECE.findall(text)]
    if _LOOSE_STOP.search(text):
        keys = text.replace("\n", " \n").split(" ")
    else:
        keys = text.replace("\n", " \n").replace(".", " .").replace(",", " ,").split(" ")
    keys[0] = "\r" + keys[0]
    return keys


def piece_text(key: str) -> str:
    """The piece that a key of ``cut_pieces`` stands for."""
    return key[1:] if key[0] == "\r" else key if key[0] in "\n.," else " " + key


class PieceEncoder:
    """Encodes texts piece by piece. Up to ``remember`` pieces are kept, and as many of the time before.

    With ``special_as_text`` a special token's content that stands in a text is spelled out in other tokens. Without it
    ids are those of the tokenizer as its file has it, as ``encoder`` wants them: the content becomes the token.
    """

    def __init__(self, path: str, remember: int = 200_000, longest: int = 64, together: int = 512, special_as_text: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        # A text that holds an added token is encoded in one go: the token cuts the text before anything else does.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not t.normalized]
        normal = self.tokenizer.normalizer
        self.added_normal = [normal.normalize_str(t.content) if normal else t.content for t in added if t.normalized]
        self.remember, self.longest, self.together = remember, longest, together
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fence = np.frombuffer(self._raw("\n" + _FENCE), "<u4")
        # Where the vocabulary marks the start or the end of a word, words need no fences between them.
        words = [self.tokenizer.id_to_token(i) or "" for i in range(self.vocabulary)]
        self.starts = np.array([w.startswith("\u0120") for w in words])
        self.ends = np.array([w.endswith("</w>") for w in words])

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _raws(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _raw(self, text: str) -> bytes:
        return self._raws([text])[0]

    def _holds_added(self, text: str) -> bool:
        if any(map(text.__contains__, self.added)):
            return True
        if not self.added_normal:
            return False
        normal = self.tokenizer.normalizer
        return any(map((normal.normalize_str(text) if normal else text).__contains__, self.added_normal))

    def _pieces(self, text: str) -> list[str] | None:
        return None if self._holds_added(text) else cut_pieces(text)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new pieces: many in one text where fences can stand between them, all others in one batch."""
        found, single = {}, []
        words, others = [], []
        for key in new:
            (words if key.isalpha() else others).append(key)
        for at in range(0, len(words), self.together):
            group = words[at:at + self.together]
            raw = self._raw(" " + " ".join(group))
            ids = np.frombuffer(raw, "<u4")
            first = np.flatnonzero(self.starts[ids])
            if len(first) != len(group):
                first = np.concatenate([[0], np.flatnonzero(self.ends[ids])[:-1] + 1])
                if len(first) != len(group) or not self.ends[ids[-1]]:
                    others += group  # the fences below
                    continue
            cuts = [*(4 * first).tolist(), len(raw)]
            found.update(zip(group, [raw[a:b] for a, b in pairwise(cuts)], strict=True))
        fenced = []
        for key in others:
            piece = piece_text(key)
            if piece[0] in " \n" and piece[-1] not in " \n" and _FENCE not in piece:
                fenced.append((key, piece))
            else:
                single.append((key, piece))
        for at in range(0, len(fenced), self.together):
            group = fenced[at:at + self.together]
            raw = self._raw("".join([p + "\n" + _FENCE for _, p in group]))
            ids, n = np.frombuffer(raw, "<u4"), len(self.fence)
            here = np.flatnonzero(ids[: len(ids) - n + 1] == self.fence[0])
            for j in range(1, n):
                here = here[ids[here + j] == self.fence[j]]
            if len(here) != len(group):
                single += group
                continue
            begin = 0
            for (key, _), end in zip(group, here.tolist(), strict=True):
                found[key] = raw[4 * begin:4 * end]
                begin = end + n
        found.update(zip([k for k, _ in single], self._raws([p for _, p in single]), strict=True))
        return found

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers; null counts as empty."""
        cut = [self._pieces(t) if t else [] for t in texts]
        # Every piece is looked up once; what is not known then is filled in after it has been learned.
        got = [list(map(self.known.get, keys)) if keys else [] for keys in cut]
        gaps = [list(compress(count(), map(not_, ids))) for ids in got]
        new = {keys[i] for keys, holes in zip(cut, gaps, strict=True) for i in holes}
        if new:
            if len(self.known) + len(new) > self.remember:
                # What this batch uses of the old table moves into the new one.
                self.older, self.known = self.known, {}
                self.known.update((k, self.older[k]) for k in set().union(*[c for c in cut if c]) if k in self.older)
            again = {k: self.older[k] for k in new if k in self.older}
            self.known |= again
            self.known |= self._learn([k for k in new if k not in again])
            for keys, holes, ids in zip(cut, gaps, got, strict=True):
                for i in holes:
                    ids[i] = self.known[keys[i]]
        out = [self._raw(t) if c is None else b"".join(ids) for t, c, ids in zip(texts, cut, got, strict=True)]
        for key in [k for k in new if len(k) > self.longest]:
            del self.known[key]
        return out


_LOADED: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path, special_as_text=False)
    return _LOADED[path]
