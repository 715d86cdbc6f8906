"""Byte-level BPE vocabularies and the exact, linear-time encoder over them.

A vocabulary file is a parameter and is read on each executor from the public
tokenizer package; it is never copied.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

#: How byte-level vocabularies split texts (fixed value, the published pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept in a task's memory; once full, further pieces are encoded each time.
CACHE_PIECES = 200_000
CACHE_LETTERS = 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Token bytes, merges and special strings of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        to_bytes = lambda shown: bytes(letters[x] for x in shown)
        self.ids = {to_bytes(shown): i for shown, i in data["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(pairs):
            a, b = to_bytes(left), to_bytes(right)
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.bytes = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Plain BPE: apply the lowest-ranked merge until none applies. The measure of all else here."""
        ids = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            ranked = [(self.merges.get(pair, (1 << 60, -1)), i) for i, pair in enumerate(zip(ids, ids[1:], strict=False))]
            (rank, merged), at = min(ranked)
            if merged < 0:
                break
            ids[at : at + 2] = [merged]
        return ids


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> dict[bytes, int]:
    """The vocabulary's strings that plain BPE encodes alone as exactly one token, with its id.

    Proven once a file and process by running plain BPE on each of them.
    """
    v = load(path)
    return {t: i for t, i in v.ids.items() if len(t) == 1 or v.merge(t) == [i]}


class BacktrackingEncoder:
    """Exact BPE of a piece in linear time.

    An Aho-Corasick automaton over the whole tokens gives the longest token at each
    position; the shorter ones there are its beginnings that are tokens, each of which
    knows the next. The encoder takes the longest one, goes on to the next shorter one
    if it may not follow its left neighbour, and steps back over the neighbour if none
    may; a position from which no ending was found is never tried again. Two tokens may
    be neighbours if plain BPE of their joined bytes gives back just the two; this
    pair-compatibility table is filled as pairs are met. A sequence of tokens that are
    compatible pairwise is the one that plain BPE makes. Memory is a few bytes a byte.
    """

    def __init__(self, path: str):
        self.v = load(path)
        self.automaton = ahocorasick.Automaton()
        whole = whole_tokens(path)
        top = max(whole.values()) + 1
        self.size, self.shorter = [0] * top, [-1] * top
        for token, i in whole.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
            self.size[i] = len(token)
            self.shorter[i] = next((whole[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in whole), -1)
        self.automaton.make_automaton()
        self.made = {i: pair for pair, (_, i) in self.v.merges.items()}
        self.rank = {i: r for r, i in self.v.merges.values()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the boundary between the two survives plain BPE of their joined bytes."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self._boundary_survives(left, right)
            if len(self.pairs) < CACHE_PIECES:
                self.pairs[left, right] = known
        return known

    def _boundary_survives(self, left: int, right: int) -> bool:
        """Undo both tokens' merges from the last to the first, seeking an earlier merge across the boundary.

        ``done`` is the rank up to which merges have happened while ``left`` and
        ``right`` are the pieces at the boundary; on equal ranks merges go from left to right.
        """
        until = (1 << 60, 0)
        while True:
            across = self.v.merges.get((left, right))
            if across is not None and (across[0], 1) < until:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # Of two pieces made by the same merge, the left one came first, so the right one is undone first.
            if a > b:
                until, left = (a, 0), self.made[left][1]
            else:
                until, right = (b, 2), self.made[right][0]

    def encode(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = array("i", bytes(4 * (n + 1)))
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # by end, so the longest comes last
        longest[n] = -1
        pairs, sizes, shorter = self.pairs, self.size, self.shorter
        tokens: list[int] = []
        dead = bytearray(n + 1)
        at, last, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                if not dead[at + sizes[token]]:
                    fits = last < 0 or pairs.get((last, token))
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += sizes[token]
                last, token = token, longest[at]
            else:
                dead[at] = 1
                back = tokens.pop()
                at -= sizes[back]
                last, token = tokens[-1] if tokens else -1, shorter[back]
        return tokens


class OffsetDecoder:
    """Decoding with one byte string of all tokens and a table of their offsets in it."""

    def __init__(self, path: str):
        v = load(path)
        size = max(v.bytes) + 1
        parts = [v.bytes.get(i, b"") for i in range(size)]
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or not ends[-1]:
            return b""
        places = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.blob[places].tobytes()


class Splitter:
    """Special strings first, then the pattern, as the vocabulary's library splits a text."""

    def __init__(self, path: str):
        self.special = load(path).special
        self.findall = regex.compile(PATTERN).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None

    def pieces(self, text: str) -> tuple[list[str], bool]:
        """The pieces in order; whether special strings, which stand for themselves, are among them."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.findall(text), False
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.findall(part)
        return out, True
