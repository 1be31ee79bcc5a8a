"""Token ids of whole texts, equal to the tokenizer's own, with the ids of words remembered per worker.

Texts are cut into words by Arrow in runs of bounded length, and each different word of a run is looked up once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Latin text in composed form, where lower-casing keeps the number of letters; anything else goes to the tokenizer whole.
LATIN = re.compile("[\x00-įı-ɏ]*")
_SPACE = " \t\n\r\x0b\x0c\x85\xa0"
#: With the lower case of Latin capitals that lies behind them.
_LETTER = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-ɏɐ-ʯⱥⱦ"
_NUMBER = "0-9²³¹¼½¾"
_PIECES = f"[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"
PLAIN = re.compile(_PIECES)
#: Contractions that the tokenizer's own pattern takes before letters.
CONTRACTED = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{_PIECES}")
#: Characters of texts that are cut into words at once; a longer text is a run of its own.
RUN = 6_000_000
#: White space to Arrow, but not to the tokenizer.
SEPARATOR = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> dict[int, int]:
    """Byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes for 256, 257, ... in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(others)}


class Ids(dict):
    """Encodes texts to little-endian uint32 ids. Maps each pre-token to its ids and keeps at most `remember` of them, in two
    halves: when the newer half is full it takes the place of the older one, less what has been asked for again."""

    def __init__(self, file: str, remember: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.remember = remember
        self.older: dict[str, bytes] = {}
        self.alphabet = byte_alphabet()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        """Ids of a word, which may be several pre-tokens."""
        pieces = [word] if word.isalpha() else (CONTRACTED if "'" in word else PLAIN).findall(word)
        if pieces != [word]:
            return b"".join([self[p] for p in pieces])
        ids = self.older.pop(word, None)
        if ids is None:
            symbols = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.alphabet)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(symbols)])
        if len(self) >= self.remember // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The tokenizer's own ids of the whole text; texts with other scripts or special strings go to it whole."""
        return self._run([text])[0]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """As `encode`, for each of the texts in turn."""
        run: list[str] = []
        n = 0
        for text in texts:
            if run and n + len(text) > RUN:
                yield from self._run(run)
                run, n = [], 0
            run.append(text)
            n += len(text)
        yield from self._run(run)

    def _run(self, texts: Sequence[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if not LATIN.fullmatch(text) or any(s in text for s in self.specials):
                out[k] = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            elif SEPARATOR.search(text):
                out[k] = b"".join(map(self.__getitem__, CONTRACTED.findall(text.lower())))
            else:
                plain.append(k)
        words = pc.utf8_split_whitespace(pa.array([texts[k].lower() for k in plain], pa.large_string()))
        each = words.flatten().dictionary_encode()
        different = each.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array([self[w] for w in different], pa.large_binary()).take(each.indices)
        _, ends, data = ids.buffers()
        if data is not None:
            at = np.frombuffer(ends, np.int64)[words.offsets.to_numpy()].tolist()
            view = memoryview(data)
            for k, a, b in zip(plain, at, at[1:], strict=False):
                out[k] = view[a:b].tobytes()
        return out


@lru_cache(1)
def remembered(file: str) -> Ids:
    """The file's encoder, kept with its words for the tasks that a Python worker runs one after the other."""
    return Ids(file)
