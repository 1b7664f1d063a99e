"""Token ids by the tokenizers library, each word's ids kept from text to text.

word_bpe_49k.json splits a text into words before it merges, and a word's ids depend on that word alone; so the library
encodes each new word once in a process, and a text's ids are those of its words in order. Texts with characters for
which lower-casing or normalising could look beyond one character go to the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

NAME = "word_bpe_49k.json"
#: The tokenizer's own split pattern (a fixed value of the vocabulary file), for lower-case Latin text: its letters and
#: numbers are those that OTHER leaves. Letters are tried first, being the most frequent; nothing else begins with one.
SPLIT = re.compile(r"[a-zªµºß-öø-ɏ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ɏ0-9²³¹¼-¾]+")
#: ASCII, Latin letters with one-letter lower case, general punctuation and the euro sign.
_COMMON = re.compile("[\x00-\x1b\x20-įı-ňŊ-ɏ‐-‧‰-⁞€]")
#: Anything but these, and the capitals among them (Ə, Ɓ and others) whose lower case isn't: SPLIT doesn't know it. One
#: set of characters, as an alternation is four times slower.
OTHER = re.compile(f"[^{re.escape(''.join(c for c in map(chr, range(0x2100)) if _COMMON.match(c) and _COMMON.fullmatch(c.lower())))}]")
#: Words kept in a process; texts whose new words would make it more begin with none kept. About 200 bytes each. Texts
#: encoded together may have more words than this: all of theirs are kept until the next.
KEPT_WORDS = 400_000
#: New words encoded at a time.
LEARNT = 50_000
#: Characters of texts encoded together: so few that their words stay in the processor's cache from step to step.
TOGETHER = 1 << 15


class WordTokenizer:
    """encode() of texts as little-endian unsigned 32-bit ids. A special token's string in a text gives its id, or is
    split as any other if ordinary."""

    _own: dict[tuple[str, bool], WordTokenizer] = {}

    def __init__(self, path: str, ordinary: bool = False):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = ordinary
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.size, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        # words are lower-cased, normalised and split already; only the model's merges are left to do
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])

    @classmethod
    def of(cls, path: str, ordinary: bool = False) -> WordTokenizer:
        """One for each process, file and treatment of special tokens."""
        if (path, ordinary) not in cls._own:
            cls._own[path, ordinary] = cls(path, ordinary)
        return cls._own[path, ordinary]

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        ids = np.array(self.merges.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(new):
            raw, at = ids.tobytes(), 0
            for word, end in zip(new, (4 * ends).tolist(), strict=True):
                self.known[word] = raw[at:end]
                at = end
        else:
            self.known.update((word, self._whole(word)) for word in new)

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        plain = [not OTHER.search(x) and not any(s in x for s in self.special) for x in texts]
        words = [SPLIT.findall((x if x.isascii() else unicodedata.normalize("NFC", x)).lower()) if p else [] for x, p in zip(texts, plain, strict=True)]
        every = set().union(*words)
        new = every.difference(self.known)
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = every
        listed = list(new)
        for at in range(0, len(listed), LEARNT):
            self._learn(listed[at : at + LEARNT])
        get = self.known.__getitem__
        for text, own, p in zip(texts, words, plain, strict=True):
            yield b"".join(map(get, own)) if p else self._whole(text)

    def forget(self) -> None:
        """Keeps no run, as at the end of a task: workers live on, and the next task learns its frequent ones soon."""
        self.known = {}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text in order; null is empty. Some texts at a time, so that memory is bounded by the longest."""
        some, size = [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= TOGETHER:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some) if some else ()


def vocabulary_path(name: str = NAME) -> str:
    return public_tokenizers.path(name)
