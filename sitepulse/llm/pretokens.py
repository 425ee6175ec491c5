"""Splitting texts into pre-tokens, the pieces that a tokenizer encodes one by one."""

from __future__ import annotations

from collections.abc import Iterator

import regex

#: Characters of which the ``regex`` module and the tokenizers library have the
#: same classes (tested): newer Unicode versions only add characters elsewhere.
SETTLED = "\x00-ԯḀ-ỿ‐-⁞ぁ-ゖァ-ヿ一-鿿가-힣"

#: Pre-tokens above this length are encoded each time they occur.
LONGEST = 64

#: Texts are split in portions of about this many characters.
PORTION = 1 << 18


def portions(text: str, size: int = PORTION) -> list[str]:
    """Cuts a long text where a space follows something else.

    The patterns' matches never hold a space after another character, so
    the parts' pre-tokens are those of the whole text.
    """
    out, start = [], 0
    while len(text) - start > size:
        at = start + size
        while at < len(text) and not (text[at] == " " and not text[at - 1].isspace()):
            at += 1
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


class Splitter:
    """All matches of a tokenizer's pattern, as the tokenizers library finds them.

    Texts of settled characters are split by the ``regex`` module, a few
    times faster; all others by the library's own pre-tokenizer.
    """

    def __init__(self, pattern: str, behavior: str = "isolated", invert: bool = False):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self._find = regex.compile(pattern).findall
        self._other = regex.compile(f"[^{SETTLED}]").search
        self._library = Split(Regex(pattern), behavior, invert)

    def __call__(self, text: str) -> list[str]:
        if self._other(text):
            return [w for w, _ in self._library.pre_tokenize_str(text)]
        return self._find(text)


class Memo(dict):
    """What became of each different pre-token, kept per worker process.

    ``compute`` answers a list of pre-tokens.  Past ``limit`` entries the
    memo starts over, so its memory is bounded; long pre-tokens are answered
    for the texts at hand only.
    """

    def __init__(self, compute, limit: int = 1 << 18):
        super().__init__()
        self._compute, self._limit = compute, limit

    def answer(self, split: list[list[str]]) -> Iterator[list]:
        """The answers of each text's pre-tokens, in their order."""
        new = list({w for ws in split for w in ws if w not in self})
        if len(self) + len(new) > self._limit:
            self.clear()
            new = list({w for ws in split for w in ws})
        self.update(zip(new, self._compute(new)))
        for ws in split:
            yield list(map(self.__getitem__, ws))
        for w in new:
            if len(w) > LONGEST:
                del self[w]
