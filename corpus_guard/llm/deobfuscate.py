"""Noisy-channel decoding of obfuscated words.

A suspicious span (signs or look-alike letters among letters, letters drawn out,
letters set apart, words joined by marks) is a lattice: each character may stand
for itself, for the letters it imitates, or for nothing when it repeats the last one
or separates letters. The Viterbi path under a letter trigram model, with a price
for each rewriting, is the restored word.

Spans are found by array operations over all characters of many texts at once;
only they reach the decoder, whose work is linear in their length. Spans of any length are
decoded; only those of at most CACHED characters are remembered.

Compatibility forms (full-width, mathematical, superscript letters and digits) are
folded to plain ones and zero-width characters are dropped everywhere. Letters of
other alphabets that look like Latin ones are rewritten only in words that hold
Latin letters too; accents stay, and words with accents are decoded only when drawn out. Exclamation marks at the end of a word are marks,
not letters, and plain words set between stars, bars or plus signs (emphasis, table
cells) are not suspicious.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

#: Letters that a sign imitates.
IMITATES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "\u20ac": "e", "\u00a3": "l", "\u00a2": "c", "\u00a1": "i",
}
#: Cyrillic and Greek letters, in lower case, and the Latin letters that they look like.
LOOKALIKES = {
    "\u0430": "a", "\u0432": "b", "\u0435": "e", "\u043a": "k", "\u043c": "m", "\u043d": "h", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0442": "t", "\u0443": "y", "\u0445": "x",
    "\u0455": "s", "\u0456": "i", "\u0458": "j", "\u04bb": "h", "\u0501": "d", "\u051b": "q", "\u051d": "w", "\u0131": "i",
    "\u03b1": "a", "\u03b5": "e", "\u03b7": "n", "\u03b9": "i", "\u03ba": "k", "\u03bd": "v", "\u03bf": "o", "\u03c1": "p", "\u03c4": "t", "\u03c5": "u", "\u03c7": "x", "\u03c9": "w",
}
SEPARATORS = " .-_*~'"
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
CLASSES = 64
#: Longest span whose decoding is remembered, and how many are.
CACHED, REMEMBERED = 60, 50_000
#: Longest word that marks join, and fewest letters that are set apart.
JOINED, APART = 12, 4
#: Characters of one piece of a very long text.
PIECE = 1 << 20
#: Prices of rewriting, in nats.
IMITATION, DROP_REPEAT, DROP_SEPARATOR, KEEP_SIGN = 0.7, 0.5, 0.3, 6.0

AZ, LETTER, SIGN, DIGIT, LIKE, GAP, JOIN, SPACE, AFTER = (1 << i for i in range(9))
WORD = AZ | LETTER | SIGN | DIGIT
_NO_MARKS = str.maketrans("", "", "*|+")
#: Places at which a long text may be cut: no span goes on over a blank that follows a word.
_CUT = re.compile(r"[^\W\d_]{3}\s")
#: Scripts without letter case, whose blocks need no look at each character.
_CASELESS = ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x17000, 0x1B000), (0x20000, 0x32000))


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the folded code point, its letter class (0 gap, 1 to 26 a-z, 27 to 63 other letters), its flags."""
    n = 0x110000
    fold, kind, flags = np.arange(n, dtype=np.uint32), np.zeros(n, np.uint8), np.zeros(n, np.uint16)
    for lo, hi in _CASELESS:
        at = np.arange(lo, hi)
        kind[lo:hi], flags[lo:hi] = 27 + at % 37, LETTER
    todo = [c for c in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x17000), *range(0x1B000, 0x1FC00))]
    for c in todo:
        ch = chr(c)
        low, plain = ch.lower(), unicodedata.normalize("NFKC", ch).lower()
        to = plain if len(plain) == 1 and plain.isascii() and plain.isalnum() else low if len(low) == 1 else ch
        fold[c] = ord(to)
        flag = AZ if "a" <= to <= "z" else LETTER if to.isalpha() else 0
        flag |= (SIGN if to in IMITATES else DIGIT if to.isalnum() and not flag else 0) | (LIKE if to in LOOKALIKES else 0)
        flag |= (GAP if to in " .-_~" else 0) | (JOIN if to in ".-_~" else 0)
        flag |= (SPACE | AFTER if to.isspace() else 0) | (AFTER if to in ".,;:?!)]\"'" else 0)
        flags[c] = flag
        kind[c] = ord(to) - 96 if flag & AZ else 27 + ord(to) % 37 if flag & LETTER else 0
    return fold, kind, flags


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def trigram_ids(text: str) -> np.ndarray:
    """Ids of the letter-class trigrams of a text, with a gap before and after it."""
    c = np.zeros(len(text) + 3, np.int64)
    got = tables()[1][points_of(text)]
    c[2 : 2 + len(got)] = got
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def _chains(link: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last run of each maximal chain of at least ``least`` runs, given whether each run is linked to the next."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], link, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    ok = last - first + 1 >= least
    return first[ok], last[ok]


def find_spans(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the suspicious spans of folded code points, and whether each is a single word."""
    flags = tables()[2][p]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], (flags & WORD) != 0, [False]]).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    if not len(lo):
        return lo, hi, np.zeros(0, bool)

    def count(bits_or_mask, end=hi):
        mask = (flags & bits_or_mask) != 0 if np.isscalar(bits_or_mask) else bits_or_mask
        total = np.zeros(len(p) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[end] - total[lo]

    n_az, n_digit, n_like, n_other = count(AZ), count(DIGIT), count(LIKE), count(LETTER)
    last = np.maximum.accumulate(np.where(p != ord("!"), np.arange(len(p)), -1))
    end = np.maximum(last[hi - 1] + 1, lo)
    n_sign = count(SIGN, end)
    drawn = np.zeros(len(p), bool)
    drawn[2:] = (p[2:] == p[1:-1]) & (p[1:-1] == p[:-2]) & ((flags[2:] & (AZ | LETTER)) != 0)
    odd = ((n_az > 0) & (n_sign + n_like > 0) & (n_digit == 0) & (n_other == n_like)) | (count(drawn) > 0)

    gap, one = lo[1:] - hi[:-1], (hi - lo == 1) & (flags[lo] & (AZ | SIGN | LIKE) != 0)
    link = one[:-1] & one[1:] & (gap <= 2) & (flags[hi[:-1]] & GAP != 0) & (flags[lo[1:] - 1] & GAP != 0)
    az = np.concatenate([[0], np.cumsum(n_az)])
    a, b = _chains(link, APART)
    some = az[b + 1] - az[a] > 0
    a, b = a[some], b[some]

    part = (hi - lo <= JOINED) & (n_az > 0) & (n_digit == 0) & (n_other == n_like)
    c, d = _chains(part[:-1] & part[1:] & (gap == 1) & (flags[hi[:-1]] & JOIN != 0), 2)
    before, behind = np.maximum(lo[c] - 1, 0), np.minimum(hi[d], len(p) - 1)
    whole = ((lo[c] == 0) | (flags[before] & SPACE != 0)) & ((hi[d] == len(p)) | (flags[behind] & AFTER != 0))
    taken = np.zeros(len(lo) + 1, np.int32)
    np.add.at(taken, a, 1)
    np.add.at(taken, b + 1, -1)
    taken = np.cumsum(taken[:-1])
    sums = np.concatenate([[0], np.cumsum(taken)])
    whole &= sums[d + 1] == sums[c]
    c, d = c[whole], d[whole]
    more = np.zeros(len(lo) + 1, np.int32)
    np.add.at(more, c, 1)
    np.add.at(more, d + 1, -1)
    alone = np.flatnonzero(odd & (taken + np.cumsum(more[:-1]) == 0))
    starts, ends = lo[np.concatenate([a, c, alone])], end[np.concatenate([b, d, alone])]
    return starts, ends, np.arange(len(starts)) >= len(a) + len(c)


class Decoder:
    def __init__(self, counts: np.ndarray):
        """counts: of the CLASSES**3 trigrams of the corpus."""
        n = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        bi, uni = n.sum(0), n.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + CLASSES)
        p2 = (bi + 50 * p1) / (bi.sum(1, keepdims=True) + 50)
        self.logp = np.log((n + 20 * p2[None]) / (n.sum(2, keepdims=True) + 20))
        self._known: dict[str, str] = {}

    def __getstate__(self):
        return {"logp": self.logp, "_known": {}}

    def options(self, ch: str, last: str) -> tuple[list[tuple[str, int, float]], float | None]:
        """What a character may be written as: (letter, its class, price), and the price of leaving it out, if it may be."""
        kind = tables()[1]
        out = [(ch, int(kind[ord(ch)]), 0.0)] if ch.isalpha() else [(" ", 0, KEEP_SIGN if ch in IMITATES else 1.5)]
        meant = IMITATES.get(ch) or LOOKALIKES.get(ch) or ""
        out += [(to, ord(to) - 96, IMITATION + 0.3 * (len(meant) - 1)) for to in meant]
        return out, DROP_REPEAT if ch == last else DROP_SEPARATOR if ch in SEPARATORS else None

    def restore(self, span: str) -> str:
        """The best path through the lattice of a span."""
        if (found := self._known.get(span)) is not None:
            return found
        logp = self.logp
        # state: last two classes -> (score, letters as linked pairs)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        last = ""
        for ch in span:
            options, drop = self.options(ch, last)
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, text) in states.items():
                if drop is not None and ((a, b) not in new or new[a, b][0] < score - drop):
                    new[a, b] = (score - drop, text)
                for to, c, price in options:
                    got = score - price + logp[a, b, c]
                    if (b, c) not in new or new[b, c][0] < got:
                        new[b, c] = (got, (text, to))
            states, last = new, ch
        path = max(((s + logp[a, b, 0], t) for (a, b), (s, t) in states.items()), key=lambda x: x[0])[1]
        out = []
        while path is not None:
            path, letter = path
            out.append(letter)
        found = "".join(reversed(out))
        if len(span) <= CACHED:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[span] = found
        return found

    def clean_points(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the folded and restored texts, one after the other with a line end between them, and where each begins."""
        fold = tables()[0]
        p = fold[points_of("\n".join(texts))]
        at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        at[-1] = len(p)
        gone = np.isin(p, points_of(ZERO_WIDTH))
        if gone.any():
            at = np.concatenate([[0], np.cumsum(~gone)])[at]
            p = p[~gone]
        starts, ends, single = find_spans(p)
        if not len(starts):
            return p, at
        text = p.tobytes().decode("utf-32-le", "replace")
        keep = np.ones(len(p), bool)
        for a, b, alone in zip(starts.tolist(), ends.tolist(), single.tolist()):
            span = text[a:b]
            if alone and span[0] in "*|+" and span[-1] in "*|+" and span.translate(_NO_MARKS).isalpha():
                continue
            got = self.restore(span)
            if got != span:
                stop = a + len(got)
                p[a:stop] = points_of(got)
                keep[stop:b] = False
        return p[keep], np.concatenate([[0], np.cumsum(keep)])[at]

    def clean(self, text: str) -> str:
        """The folded text with its suspicious spans restored."""
        return self.clean_points([text])[0].tobytes().decode("utf-32-le", "replace")


def pieces(text: str, size: int = PIECE):
    """Pieces of ``size`` to twice ``size`` characters of a text, cut where no span goes on.

    Where there is no such place in ``size`` characters (numbers, spaced letters, a text without blanks) the cut is at the last
    blank before twice ``size``, or there: a span over it is restored in two parts, and memory stays bounded.
    """
    at = 0
    while len(text) - at > 2 * size:
        if m := _CUT.search(text, at + size, at + 2 * size):
            end = m.end()
        else:
            end = max(text.rfind(" ", at + size, at + 2 * size), text.rfind("\n", at + size, at + 2 * size)) + 1 or at + 2 * size
        yield text[at:end]
        at = end
    yield text[at:] if at else text
