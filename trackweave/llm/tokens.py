"""Tokens of many texts at once, as hashes in arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Characters that are tokenised at a time; a longer text is cut at line ends.
PIECE = 1 << 18
#: White space beyond one byte, all of which parts tokens but ends no line.
_SPACE = re.compile("[\x85\xa0  -     　]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Bytes of variable fields: digits and ``@``.
_IS_FIELD = np.zeros(256, bool)
_IS_FIELD[[*range(48, 58), 64]] = True
_BYTES = np.random.default_rng(1).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP, _LINE, _PAIR = np.uint64(0x9E3779B97F4A7C13), np.uint64(0xD1342543DE82EF93), np.uint64(0xAF251AF3B0F025B7)
#: The hash of every variable field, ``<*>``.
FIELD = np.uint64(0x2545F4914F6CDD1D)


def mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _powers(step: np.uint64, n: int, known: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of an odd ``step`` and of its inverse modulo 2^64, up to the ``n``-th; kept between calls."""
    if int(step) not in known or len(known[int(step)][0]) <= n:
        upto = 1 << max(PIECE.bit_length(), (n + 1).bit_length())
        back = np.uint64(pow(int(step), -1, 1 << 64))
        known[int(step)] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(upto - 1, base, np.uint64), dtype=np.uint64)]) for base in (step, back))
    return known[int(step)]


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: np.uint64) -> np.ndarray:
    """A hash of each run of ``values``, by a polynomial in ``step``: differences of running sums."""
    up, down = _powers(step, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def pieces(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Groups of (text number, number of its first line, lines), of about ``PIECE`` characters."""
    group, size = [], 0
    for n, text in enumerate(texts):
        at = line = 0
        while at <= len(text):
            end = len(text)
            if end - at > PIECE:
                cut = text.rfind("\n", at, at + PIECE)
                if cut < 0:
                    cut = text.find("\n", at + PIECE)
                end = cut if cut >= 0 else end
            part = text[at:end]
            group.append((n, line, part))
            size += len(part)
            line += part.count("\n") + 1
            at = end + 1
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


class Tokens:
    """Hashes of the tokens of lines, for texts or pieces of them.

    Texts are lower-cased and split at white space; a token with a digit, an ``@`` or
    ``://`` is a variable field.  ``text``, ``line`` and ``count`` describe the lines that
    have tokens, in order; ``first`` is where a line's tokens begin in ``hashes``.
    """

    def __init__(self, group: list[tuple[int, int, str]]):
        lowered = [part.lower() for _, _, part in group]
        lowered = [p if p.isascii() else _SPACE.sub(" ", p) for p in lowered]
        raw = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
        edge = np.empty(len(raw) + 1, bool)  # where white space begins or ends
        space = _IS_SPACE[raw]
        edge[0], edge[-1] = not space[0], not space[-1]
        np.not_equal(space[1:], space[:-1], out=edge[1:-1])
        edges = np.flatnonzero(edge)
        starts, ends = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            self.hashes = _runs(_BYTES[raw], starts, ends, _STEP)
        field = np.flatnonzero(_IS_FIELD[raw])
        colon = np.flatnonzero(raw[:-2] == 58)
        field = np.append(field, colon[(raw[colon + 1] == 47) & (raw[colon + 2] == 47)])
        self.hashes[np.searchsorted(starts, field, side="right") - 1] = FIELD
        line = np.searchsorted(np.flatnonzero(raw == 10), starts)
        self.first = np.flatnonzero(np.diff(line, prepend=-1))
        self.count = np.diff(np.append(self.first, len(line)))
        lines = np.array([part.count("\n") + 1 for _, _, part in group], np.int64)
        text = np.repeat([n for n, _, _ in group], lines)
        number = np.concatenate([np.arange(begin, begin + k) for (_, begin, _), k in zip(group, lines.tolist())])
        here = line[self.first]
        self.text, self.line = text[here], number[here]

    def paths(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each line and of its leaf: its number of tokens and its leading ones."""
        with np.errstate(over="ignore"):
            key = _runs(self.hashes, self.first, self.first + self.count, _LINE)
            leaf = mixed(self.count.astype(np.uint64) * _PAIR)
            for k in range(depth):
                at = np.minimum(self.first + k, max(0, len(self.hashes) - 1))
                leaf = np.where(self.count > k, mixed(leaf * _LINE + self.hashes[at]), leaf)
        return key.view(np.int64), leaf.view(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(which line, hash) of all pairs of neighbouring tokens; a token that is alone is one."""
        which = np.repeat(np.arange(len(self.first)), self.count)
        with np.errstate(over="ignore"):
            follow = np.append(self.hashes[1:], np.uint64(0))
            last = np.ones(len(which), bool)
            last[:-1] = which[1:] != which[:-1]
            alone = last & (self.count[which] == 1)
            follow = np.where(alone, np.uint64(0), follow)
            hashed = mixed(self.hashes * _PAIR + follow)
        keep = ~last | alone
        return which[keep], hashed[keep].view(np.int64)

    def least_pairs(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(ends, hashes): of each line the ``most`` least hashes of its different pairs, in order."""
        which, hashed = self.pairs()
        # one sort of lines and the leading bits of hashes; a line's equal hashes come together
        lead = (hashed.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(24)
        order = np.argsort((which.astype(np.uint64) << np.uint64(40)) | lead)
        which, hashed = which[order], hashed[order]
        fresh = np.ones(len(which), bool)
        fresh[1:] = (which[1:] != which[:-1]) | (hashed[1:] != hashed[:-1])
        which, hashed = which[fresh], hashed[fresh]
        count = np.bincount(which, minlength=len(self.first))
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        few = place < most
        return np.cumsum(np.minimum(count, most)), hashed[few]

    def row(self, which: int) -> np.ndarray:
        """A line's tokens as 32-bit hashes, none of them 0."""
        part = (self.hashes[self.first[which] : self.first[which] + self.count[which]] >> np.uint64(32)).astype(np.uint32)
        part[part == 0] = 1
        return part.view(np.int32)


def tokenised(texts: list[str]) -> Iterator[Tokens]:
    """Tokens of all the texts, in groups that bound memory."""
    return map(Tokens, pieces(texts))
