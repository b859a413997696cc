"""Whole texts to token ids with the tokenizers library, word by word.

A tokenizer splits a text into words before it merges, so the ids of a
text are those of its words in order.  Each worker encodes a distinct word
once and keeps its ids (a bounded number of words; the ones in use stay); a
text is then a lookup per word.  Cuts lie only where the tokenizer cuts too:

* ``word`` files drop white space: cut at ASCII white space.
* ``byte`` files keep a space with the word after it: cut before a space
  or line feed that follows a character other than white space.  Texts
  with runs of white space take the general cut.

Both shortcuts are taken only for files whose normaliser and splitter are
the ones they were made for; with any other file the library encodes whole
texts.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable

#: Words of a cache's younger half; the older half holds as many at most.
CACHED_WORDS = 600_000
#: Precomposed Latin letters, then ASCII punctuation other than apostrophe and underscore.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-į]+)([!-&(-/:-@\[-^`{-~]*)")
_CUT = re.compile(r"(?<!\s)(?=[ \n])")
_ODD = re.compile(r"[^\S \n]")

# The normalisers and splitters that the shortcuts hold for.
_KEEPS_SPACE = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_DROPS_SPACE = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})


class WordIds(dict):
    """word -> what ``encode`` gives for it, filled on demand.  When the
    younger words reach their bound they become the older ones, and an older
    word that is asked for again is young: rare words go, others stay."""

    def __init__(self, encode: Callable[[str], object], bound: int = CACHED_WORDS):
        super().__init__()
        self.encode, self.bound, self.older = encode, bound, {}

    def __missing__(self, word: str):
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
            if len(word) > 64:  # long runs are encoded as they come
                return ids
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


def packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other
    bytes in order for the letters from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """``encode(text)``: the ids of the whole text as little-endian unsigned
    32-bit bytes.  With ``plain_specials`` the strings of special tokens in
    a text are ordinary text."""

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cut = (said.get("normalizer"), said.get("pre_tokenizer"))
        bpe = said["model"].get("type") == "BPE" and not said["model"].get("dropout")
        self.keeps_space, self.drops_space = bpe and cut == _KEEPS_SPACE, bpe and cut == _DROPS_SPACE
        self.specials = [] if plain_specials else [t["content"] for t in said.get("added_tokens", ())]
        self.letter = byte_letters()
        self.first = WordIds(lambda w: self._word("", w))
        # after a space; a word that begins with a line feed follows that instead
        self.spaced = WordIds(lambda w: self._whole(w) if w[:1] == "\n" else self._word(" ", w))

    def _whole(self, s: str) -> bytes:
        return packed(self.tokenizer.encode(s, add_special_tokens=False).ids)

    def _word(self, space: str, word: str) -> bytes:
        """A word's ids.  Plain words (Latin letters, or those and then
        punctuation) need no normalisation or splitting, so the library's
        merges are asked directly."""
        if word.isalpha() and word.isascii():  # stands for itself in the byte-level alphabet
            plain = "\u0120" + word if space else word if self.keeps_space else word.lower()
            return packed([t.id for t in self.tokenizer.model.tokenize(plain)])
        m = _PLAIN.fullmatch(word)
        if not m:
            return self._whole(space + word)
        if m[2]:
            return (self.spaced if space else self.first)[m[1]] + self.first[m[2]]
        plain = space + (word if self.keeps_space else word.lower())
        return packed([t.id for t in self.tokenizer.model.tokenize(plain.encode().decode("latin-1").translate(self.letter))])

    def _lowered(self, text: str) -> str:
        """Latin-1 texts lower-case letter by letter, as the file's normalisation does: fewer distinct words.
        Texts that would then hold a special token's string stay as they are."""
        try:
            low = text.encode("latin-1").decode("latin-1").lower()
        except UnicodeEncodeError:
            return text
        return text if any(s in low for s in self.specials) else low

    def encode(self, text: str) -> bytes:
        if self.drops_space:
            text = self._lowered(text)
            # str.split also splits at four control characters that are no white space to the tokenizer
            words = text.split() if text.isprintable() or not re.search("[\x1c-\x1f]", text) else re.split(r"[ \t\n\r\f\v]+", text)
            return b"".join(map(self.first.__getitem__, words))
        if not self.keeps_space:
            return self._whole(text)
        if ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in (" ", "\n")
                or not text.replace("\n", "").isprintable() and _ODD.search(text)):
            return b"".join(map(self.first.__getitem__, _CUT.split(text)))
        words = text.replace("\n", " \n").split(" ")
        if not words[0] and len(words) > 1 and words[1][:1] == "\n":  # the text begins with a line feed
            return b"".join(map(self.spaced.__getitem__, words[1:]))
        return self.first[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:]))


_open: dict[tuple, Encoder] = {}


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    key = (path, plain_specials)
    if key not in _open:
        _open[key] = Encoder(path, plain_specials)
    return _open[key]
