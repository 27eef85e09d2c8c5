"""Token ids by public tokenizers, cached per word in each Python worker."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np

#: Bytes of words and ids that a worker keeps, in two generations of half as many.
CACHE_BYTES = 96 << 20
#: What an entry takes besides its characters and ids.
ENTRY_BYTES = 200
#: Characters of a text that are cut into words at a time.
SLICE = 1 << 20

# Letters whose classes, lower case and normal form are the same in every Unicode version and don't depend on their neighbours.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž"
SMALL = "a-zß-öø-įĳ-ňŋ-ž"
BLANK = " \\t-\\r"
PLAIN = re.compile(rf"[\x00-\x7F{LETTERS}]*")
#: Fixed value: the words of the tokenizer, for lower-case text of plain characters.
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{SMALL}]+|[0-9]|[^{BLANK}0-9{SMALL}]+")
CHUNK = re.compile(rf"[^{BLANK}]+")
NEXT_BLANK = re.compile(rf"[{BLANK}]")
SPECIAL = "<|"


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sliced(text: str) -> Iterator[str]:
    """The text, cut at blanks into parts of some :data:`SLICE` characters."""
    at = 0
    while len(text) - at > SLICE:
        blank = NEXT_BLANK.search(text, at + SLICE)
        if not blank:
            break
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:]


class WordCachedTokenizer:
    """Exact ids of a lower-casing tokenizer whose pieces never cross its words.

    Plain text is lower-cased and cut into words here, by the tokenizer's own
    pattern; other text is cut at ASCII blanks, and each chunk with any
    character that is not plain, or with what may be a special token, goes
    through the tokenizer as it is.  The ids of each word and chunk are kept as
    little-endian unsigned 32-bit bytes, and only those not seen before are
    tokenized.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        # The same pieces for words that are cut already: nothing is normalized or cut again but at blanks.
        with open(path, encoding="utf-8") as file:
            bare = json.load(file)
        bytes_of = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        bare |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_of]}}
        self.pieces = Tokenizer.from_str(json.dumps(bare))
        vocabulary = self.pieces.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.limit, self.held = cache_bytes // 2, 0
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Chunks of the lists at hand that are not plain.
        self.odd: set[str] = set()

    @cached_property
    def tokenizer(self):
        """The whole tokenizer, read when the first chunk needs it."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.encode_special_tokens = False
        return whole

    def words(self, text: str) -> list[str]:
        """Words and chunks of a text."""
        if PLAIN.fullmatch(text) and SPECIAL not in text:
            return WORD.findall(text.lower())
        out: list[str] = []
        for chunk in CHUNK.findall(text):
            if PLAIN.fullmatch(chunk) and SPECIAL not in chunk:
                out += WORD.findall(chunk.lower())
            else:
                out.append(chunk)
                self.odd.add(chunk)
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, 4 bytes each."""
        out, cut, size = [], [], 0
        for text in texts:
            if size + len(text or "") > SLICE:
                out += self.known(cut)
                cut, size = [], 0
            if text and len(text) > SLICE:
                # One part at a time: the words of a very long text never stand in memory together.
                out.append(b"".join(self.known([self.words(x)])[0] for x in sliced(text)))
            else:
                cut.append(self.words(text) if text else [])
                size += len(text or "")
        return out + self.known(cut)

    def known(self, cut: list[list[str]]) -> list[bytes]:
        """The ids of lists of words."""
        if self.held > self.limit:
            self.cache, self.older, self.held = {}, self.cache, 0
        cache = self.cache
        if fresh := set().union(*cut).difference(cache):
            self.learn(fresh)
        self.odd.clear()
        return [b"".join(map(cache.__getitem__, words)) for words in cut]

    def learn(self, fresh: set[str]) -> None:
        cache, older = self.cache, self.older
        # Words of the generation before come back without the tokenizer.
        for w in [w for w in fresh if w in older]:
            cache[w] = older[w]
            self.held += ENTRY_BYTES + len(w) + len(older[w])
            fresh.discard(w)
        plain = list(fresh.difference(self.odd))
        for at in range(0, len(plain), 512):
            self.learn_words(plain[at : at + 512])
        self.learn_chunks(list(fresh.intersection(self.odd)))

    def learn_words(self, words: list[str]) -> None:
        """Words that are one word each to the tokenizer: their ids end where a word's end is."""
        ids = np.asarray(self.pieces.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(words):
            return self.learn_chunks(words)
        data, start = ids.tobytes(), 0
        for w, end in zip(words, ends.tolist()):
            self.cache[w] = data[start:end]
            self.held += ENTRY_BYTES + len(w) + end - start
            start = end

    def learn_chunks(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 256):
            part = chunks[at : at + 256]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.cache[w] = np.asarray(e.ids, "<u4").tobytes()
                self.held += ENTRY_BYTES + len(w) + len(self.cache[w])


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordCachedTokenizer:
    """One tokenizer a worker."""
    return WordCachedTokenizer(path)


def forget() -> None:
    """Lets go of a worker's words: other stages call it, as workers are used again."""
    word_tokenizer.cache_clear()


@lru_cache(maxsize=4)
def byte_tokenizer(path: str):
    """A tiktoken encoding of a rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
