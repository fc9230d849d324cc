"""Encoding with a public tokenizer, word by word, with remembered words.

The tokenizer of ``word_bpe_49k.json`` drops white space and never joins characters
across it, so the ids of a text are those of its words in order. Texts are encoded
many at once: the distinct words of a slice of a column are parted into letters, in
lower case, and the marks behind them, and looked up in a table of parts by Arrow;
only parts that the table does not hold are encoded, and the ids of all words are
gathered from theirs with numpy. Each Python worker keeps its table, an Arrow array of
parts and numpy arrays of their ids. It is bounded in number and in bytes; beyond
that, the half that was used in most slices stays. Another vocabulary is encoded by whole texts.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallybox.llm.common import word_codes

TOKENIZER = "word_bpe_49k.json"
#: Words whose parts are encoded on their own: letters that neither the normal form nor splitting changes, then printable ASCII without letters and digits.
PARTS = r"^(?P<letters>[a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
#: Letters in lower case, which are in their normal form.
LETTERS = r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+$"
ID = np.dtype("<u4")
#: Bytes of the longest part that is kept, and of a slice of texts.
LONGEST, SLICE = 40, 1 << 23
#: Words whose ids are gathered at once.
GATHERED = 1 << 18


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    return np.repeat(start - _starts(size), size) + np.arange(int(size.sum()))


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.by_words = os.path.basename(path) == TOKENIZER  # the rules here hold for this vocabulary
        self.limit = limit
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.spelling = {k: c for k, c in enumerate(byte_letters())}
        # the table: parts, how many ids each has, these ids, and in how many slices it was used
        self.parts, self.size, self.ids, self.used = pa.array([""], pa.string()), np.zeros(1, np.int64), np.zeros(0, ID), np.zeros(1, np.int64)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def _encoded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part has, and the ids of all."""
        tokenize, spelling, sizes, ids = self.whole.model.tokenize, self.spelling, [], array("I")
        for part, plain in zip(parts.to_pylist(), pc.match_substring_regex(parts, LETTERS).to_pylist(), strict=True):
            before = len(ids)
            if plain:
                ids.extend([t.id for t in tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(spelling))])
            else:
                ids.extend(self.whole.encode(part, add_special_tokens=False).ids)
            sizes.append(len(ids) - before)
        return np.array(sizes, np.int64), np.array(ids, ID)

    def _rows(self, parts: pa.Array) -> np.ndarray:
        """The row of each part in the table, which takes in those that it does not hold."""
        at = pc.index_in(parts, value_set=self.parts)
        lost = at.is_null()
        rows = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = parts.filter(lost).dictionary_encode()
        if len(new):
            rows[lost.to_numpy(zero_copy_only=False)] = len(self.parts) + new.indices.to_numpy(zero_copy_only=False)
            size, ids = self._encoded(new.dictionary)
            self.parts = pa.concat_arrays([self.parts, new.dictionary])
            self.size, self.ids, self.used = np.concatenate([self.size, size]), np.concatenate([self.ids, ids]), np.concatenate([self.used, np.zeros(len(size), np.int64)])
        return rows

    def _shrink(self) -> None:
        """Of a table beyond its bounds, the most used half stays, and counts half."""
        length = pc.binary_length(self.parts).to_numpy(zero_copy_only=False)
        if len(length) <= self.limit and int(length.sum()) <= LONGEST // 2 * self.limit and len(self.ids) <= LONGEST // 2 * self.limit:
            return
        short = np.flatnonzero(length <= LONGEST)
        most = np.sort(short[np.argsort(-self.used[short], kind="stable")[: self.limit // 2]])
        self.ids = self.ids[_spans(_starts(self.size)[most], self.size[most])]
        self.parts, self.size, self.used = self.parts.take(pa.array(most)), self.size[most], self.used[most] // 2

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some distinct words has, and the ids of all. Words of another form are one part."""
        found = pc.extract_regex(words, PARTS)
        first = pc.if_else(found.is_valid(), pc.utf8_lower(pc.struct_field(found, [0])), words)
        second = pc.struct_field(found, [1]).fill_null("")
        rows = self._rows(pa.concat_arrays([first, second])).reshape(2, -1).T.ravel()
        self.used += np.bincount(rows, minlength=len(self.used)) > 0
        size = self.size[rows]
        ids = self.ids[_spans(_starts(self.size)[rows], size)]
        self._shrink()
        return size.reshape(-1, 2).sum(axis=1), ids

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column."""
        if not self.by_words:
            for t in texts:
                yield self._whole(t.as_py() or "")
            return
        for words, codes, ends in word_codes(texts, SLICE):
            size, ids = self._words(words)
            start, k = _starts(size), 0
            while k < len(ends) - 1:  # some texts at once, a longer one alone
                to = max(k + 1, int(np.searchsorted(ends, ends[k] + GATHERED, side="right")) - 1)
                own = codes[ends[k] : ends[to]]
                each = size[own]
                found = memoryview(ids[_spans(start[own], each)].tobytes())
                stops = (np.concatenate([[0], np.cumsum(each)])[ends[k : to + 1] - ends[k]] * ID.itemsize).tolist()
                for x, y in zip(stops, stops[1:], strict=False):
                    yield found[x:y].tobytes()
                k = to

    def encode(self, text: str | None) -> bytes:
        return next(self.column(pa.array([text], pa.string())))


_LOADED: dict[str, WordTokenizer] = {}


def forget() -> None:
    """Give up the tokenizers of this worker: called by operators that don't need them, as Spark uses workers again."""
    _LOADED.clear()


def tokenizer(path: str | None = None) -> WordTokenizer:
    """The tokenizer of a file, loaded once in each Python worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
