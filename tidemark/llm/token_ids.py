"""Byte-level BPE ids through the tokenizers library, with a cache of encoded words.

A single U+0020 between two characters that are not white space always begins a new pre-token, since
the space can only attach to what follows it; a single line feed there is one of its own. Cutting a text
before these and encoding the parts one by one therefore gives the library's ids for the whole text, and
natural text repeats its parts. Texts are cut and their parts told apart in columns, and only distinct ones
are looked up. Parts that are plain Latin words go straight to the library's merge model, others through
its whole encoder.

The string of a special token in a text is that token, as the library reads it, unless ``plain_specials``
makes it ordinary text. A vocabulary with a special token that has white space in it is not cut into parts.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer parts are encoded but not kept, and the cache is aged at so many entries: about 150 MB at most.
CACHED_CHARS, CACHE_ENTRIES = 48, 250_000
#: Bytes of text that are best encoded in one call, and parts whose ids are gathered at a time.
CALL_BYTES = 4 << 20
GATHERED = 1 << 18
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ʯ]+")
_TWO = re.compile(r"\s\s")
#: A word, perhaps with the line feed before it, and what punctuation ends it, of characters that all versions
#: of Unicode class alike.
_WORD = r"(?P<stem>\n?[A-Za-zÀ-ÖØ-öø-ʯ]+)(?P<mark>[!-/:-@\[-`{-~]*)"


def id_dtype(vocabulary: int) -> np.dtype:
    """The narrowest little-endian unsigned type for ids below ``vocabulary``."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids by part; a part that is missing is encoded and kept. Two generations bound the memory."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.encode(part)
        if len(part) <= CACHED_CHARS:
            self[part] = ids
        return ids

    def trim(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Encodes texts to bytes of little-endian ids (``dtype``)."""

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = not plain_specials and any(c.isspace() for t in added for c in t)
        # Parts of letters alone are looked up without the library's search for added tokens.
        self.whole |= any(t.isalpha() for t in added)
        self.dtype = id_dtype(self.tokenizer.get_vocab_size())
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.space, self.line, self.line_ids = self.letters[32], "\n", self._whole("\n")
        self.words, self.marks = _Words(self._part), _Words(self._whole)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a part that begins with a line feed, or else has a space before it."""
        head, stem = (self.line, part[1:]) if part[:1] == "\n" else (self.space, part)
        if stem.isascii() and stem.isalpha():
            written = stem
        elif _LETTERS.fullmatch(stem):
            written = stem.encode().decode("latin-1").translate(self.letters)
        else:
            return self._whole(part if head == self.line else " " + part)
        if head == self.line:
            return self.line_ids + array(self.code, [t.id for t in self.merge(written)]).tobytes()
        return array(self.code, [t.id for t in self.merge(head + written)]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        even = [] if self.whole else [i for i, t in enumerate(texts) if t[:1] != " " and not _TWO.search(t)]
        out = [b""] * len(texts)
        for i in sorted(set(range(len(texts))).difference(even)):
            out[i] = self._whole(texts[i]) if self.whole else self._cut(texts[i])
        for i, ids in zip(even, self._split([texts[i] for i in even]), strict=True):
            out[i] = ids
        self.words.trim()
        self.marks.trim()
        return out

    def _cut(self, text: str) -> bytes:
        parts = _CUT.split(text)
        parts[0] = self._whole(parts[0]) if parts[0] else b""
        parts[1:] = map(self.words.__getitem__, parts[1:])
        return b"".join(parts)

    def _split(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut at every space and line feed, gathered from those of distinct parts."""
        if not texts:
            return []
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        found, at = lists.values.dictionary_encode(), lists.offsets.to_numpy()
        told = pc.extract_regex(found.dictionary, f"^{_WORD}$")
        stems = pc.coalesce(pc.struct_field(told, "stem"), found.dictionary).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(told, "mark"), "").dictionary_encode()
        firsts = lists.values.take(pa.array(at[:-1])).to_pylist()  # no space stands before these
        ids = [*map(self.words.__getitem__, stems.dictionary.to_numpy(zero_copy_only=False).tolist())]
        ids += [*(self.marks[x] if x else b"" for x in marks.dictionary.to_pylist()), *(self._whole(x) if x else b"" for x in firsts), b""]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        table, begins = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(sizes) - sizes
        # Every part is two entries of the table: its stem and its mark.
        kinds = found.indices.to_numpy()
        entries = np.empty((len(kinds), 2), np.int64)
        entries[:, 0] = stems.indices.to_numpy()[kinds]
        entries[:, 1] = marks.indices.to_numpy()[kinds] + len(stems.dictionary)
        entries[at[:-1], 0] = len(ids) - 1 - len(firsts) + np.arange(len(firsts))
        entries[at[:-1], 1] = len(ids) - 1
        made, totals = [], [np.zeros(1, np.int64)]
        for k in range(0, len(entries), GATHERED):
            own = entries[k : k + GATHERED].ravel()
            size = sizes[own]
            ends = np.cumsum(size)
            made.append(table[np.repeat(begins[own] - ends + size, size) + np.arange(ends[-1])].tobytes())
            totals.append(ends[1::2] + totals[-1][-1])
        whole, cuts = b"".join(made), np.concatenate(totals)[at] * self.dtype.itemsize
        return [whole[x:y] for x, y in itertools.pairwise(cuts.tolist())]


@lru_cache(maxsize=2)
def word_encoder(path: str, plain_specials: bool = False) -> WordEncoder:
    """One encoder for each worker process, vocabulary file and reading of special tokens."""
    return WordEncoder(path, plain_specials)


def ended(encode: WordEncoder, texts: list[str], end_id: int, dtype: np.dtype) -> list[bytes]:
    """Ids of each text and the end id, as ``dtype``."""
    end = np.array([end_id], dtype).tobytes()
    if encode.dtype == dtype:
        return [x + end for x in encode(texts)]
    return [np.frombuffer(x, encode.dtype).astype(dtype).tobytes() + end for x in encode(texts)]
