"""Hashed terms of whole texts: words and neighbouring words of each sentence, found in arrays of bytes, not in a loop over words."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

#: Hashed terms of a model, a fixed size whatever the vocabulary.
TERMS = 1 << 17
#: Bytes worked on at once; a longer text is worked on in several pieces, all of them.
PIECE = 1 << 20

_HIDDEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_ODD = re.compile(r"[^\w\s\x00-\x7f]")
_BREAK = re.compile(r"<\s?(?:br|/p|/div|/li|/tr|/h\d)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[^<>]+>")


def _bytes_in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, "uint8")] = True
    return out


LETTER = _bytes_in(b"abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
WORD = LETTER | _bytes_in(b"0123456789_")
BLANK = _bytes_in(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")
STOP, HARD = _bytes_in(b".!?;"), _bytes_in(b"|\n")
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, "uint64")
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_UP, _DOWN = _powers(_BASE, 2 * PIECE + 2), _powers(pow(_BASE, -1, 1 << 64), 2 * PIECE + 2)


def cleaned(text: str) -> bytes:
    """TEXT in lower case without markup, escapes and hidden characters; letters in their compatible form.

    Every pattern stops at the next angle bracket, so the time grows with the length of a text and no faster.
    """
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = _TAG.sub(" ", _BREAK.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    text = text.lower()
    return text.encode("utf-8", "replace") if text.isascii() else _ODD.sub(" ", text).encode("utf-8", "replace")


def blocks(texts: list) -> Iterator[tuple[list[bytes], list[int]]]:
    """The cleaned TEXTS with their places, in blocks of about PIECE bytes. A longer text is cut at a blank, where one is near."""
    held, owner, size = [], [], 0
    for k, text in enumerate(texts):
        whole = cleaned(text) if text else b""
        at = 0
        while at < len(whole):
            end = at + PIECE
            if end < len(whole):
                blank = whole.rfind(b" ", at + PIECE // 2, end)
                end = blank if blank > at else end
            part = whole[at:end]
            at = end
            if size and size + len(part) >= PIECE:
                yield held, owner
                held, owner, size = [], [], 0
            held.append(part)
            owner.append(k)
            size += len(part) + 1
    if held:
        yield held, owner


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def block_words(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, words of each sentence, text of each sentence). Parts of a token with a dot inside, hosts for the most, are no words."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", "uint8")
    n = len(data)
    turns = np.diff(LETTER[data].view("int8"), prepend=np.int8(0))
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    blank = BLANK[data]
    ends_here = STOP[data]
    ends_here[:-1] &= blank[1:]
    ends_here |= HARD[data]
    sentence = np.cumsum(ends_here, dtype="int32")[starts]
    dots = np.flatnonzero(data == 46)
    if len(dots):
        around = np.concatenate([np.full(2, 10, "uint8"), data, np.full(2, 10, "uint8")])
        left, right = around[dots + 1], around[dots + 3]
        left = np.where(left == 91, around[dots], left)
        right = np.where(right == 93, around[dots + 4], right)
        token = np.cumsum(blank, dtype="int32")
        host = np.zeros(int(token[-1]) + 1, bool)
        host[token[dots[WORD[left] & WORD[right]]]] = True
        kept = ~host[token[starts]]
        starts, ends, sentence = starts[kept], ends[kept], sentence[kept]
    if not len(starts):
        return np.zeros(0, "uint32"), np.zeros(0, "int32"), np.zeros(0, "int64")
    up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1))
    total = np.zeros(n + 1, "uint64")
    np.cumsum(data * up[:n], out=total[1:])
    words = _mixed((total[ends] - total[starts]) * down[starts]).astype("uint32")
    new = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    part = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts[new], side="right")
    return words, np.diff(np.append(new, len(words))).astype("int32"), np.asarray(owners, "int64")[part]


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`block_words` over all TEXTS; a null or blank text has none."""
    found = [block_words(parts, owners) for parts, owners in blocks(texts)]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, "uint32"), np.zeros(0, "int32"), np.zeros(0, "int64"))


def ngrams(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, its sentence): the words, then the pairs of neighbours in a sentence, of sentences of so many words."""
    place = np.repeat(np.arange(len(lengths)), lengths)
    same = place[1:] == place[:-1]
    one = words.astype("uint64")
    two = _mixed(one[:-1] * np.uint64(_BASE) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))[same]
    return (np.concatenate([one, two]) & np.uint64(TERMS - 1)).astype("int64"), np.concatenate([place, place[1:][same]])
