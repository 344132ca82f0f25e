"""Words of a text as contamination search compares them."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

#: Tags that stand inside a line, so that text around them is not parted.
INLINE_TAGS = "a abbr b bdi bdo big cite code em font i kbd mark s samp small span strong sub sup tt u var wbr"

_INLINE = re.compile(r"</?(?:" + "|".join(INLINE_TAGS.split()) + r")(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_BREAK = re.compile(r"(?<=[^\W\d_])[-­‐‑][ \t\r]*\n\s*(?=[^\W\d_])")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_NEVER = re.compile("[<&­-￿]|[-]\\s*\n")


def plain(text: str) -> str:
    """The text without markup, references, invisible characters and line-end hyphens, NFKC, case folded."""
    if _NEVER.search(text) is None and text.isascii():
        return text.lower()
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    text = _INVISIBLE.sub("", _BREAK.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return text.casefold()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits; none for null."""
    return _WORD.findall(plain(text)) if text else []


class WordHashes:
    """64-bit hashes of words, remembered for the frequent ones."""

    def __init__(self, most: int = 1 << 18) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, items: list[str]) -> np.ndarray:
        known = self.known
        out = np.empty(len(items), np.uint64)
        try:
            out[:] = [known[w] for w in items]
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in items:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            out[:] = [known[w] for w in items]
        return out


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))
