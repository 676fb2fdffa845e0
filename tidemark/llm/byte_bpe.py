"""Byte-level BPE from a file of ranks: vectorised pre-tokenisation, cached pair merging, exact decoding.

Pre-tokens are found without matching the pattern. Every code point gets a class, every class and that
of its successor a symbol, and a symbol is a function on the eight states that the pattern can be in.
Composition of such functions is associative, and all that can arise by composition are a few dozen, so
a function fits in a byte and composition is a look-up. Lanes of the text are composed side by side,
a scan over the lanes gives the state in which each begins, and a second pass yields the boundaries.

Pieces are merged by rank with all new pieces of a step side by side, and kept by their text. Each id
stands for fixed bytes, so the ends of tokens in the text are known and decoding is a gather.

Rows: a null or empty text has no tokens and decodes to no bytes; repeated rows encode alike. Very long
texts are encoded whole, one a step; a single piece of any length takes n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts_only

#: Pieces kept in each of two generations; longer pieces than this aren't kept.
CACHE_ENTRIES, CACHED_CHARS = 400_000, 48
#: Pieces up to so many bytes are merged side by side, longer ones on their own.
SHORT = 48
LANE = 64

# The pattern's classes, symbols and states.
LETTER, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, STMD, RV, ELL, EE, END = range(11)
S_LETTER, S_SHORT, S_LONG, S_NUMBER, S_OTHER, S_APOSTROPHE, S_SPACE, S_WHITE, S_RUN, S_NONE = range(10)
BREAK, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, AFTER_APOSTROPHE, IN_SUFFIX = range(8)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, as the rank library's own tables of letters, numbers and white space have it."""
    import tiktoken

    table = np.full(0x110000, OTHER, np.uint8)
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(probe.encode_ordinary(text)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    for chars, kind in (("'", APOSTROPHE), (" ", SPACE), ("stmd", STMD), ("rv", RV), ("l", ELL), ("e", EE)):
        table[[ord(c) for c in chars]] = kind
    return table


def _symbols() -> np.ndarray:
    """Symbol by class and class of the next code point (END after the last)."""
    out = np.full((END + 1, END + 1), S_NONE, np.uint8)
    white = (SPACE, WHITE)
    for kind in range(END):
        for after in range(END + 1):
            if kind in white:
                last = after not in (*white, END)
                out[kind, after] = (S_SPACE if kind == SPACE else S_WHITE) if last else S_RUN
            elif kind in (NUMBER, OTHER, APOSTROPHE):
                out[kind, after] = {NUMBER: S_NUMBER, OTHER: S_OTHER, APOSTROPHE: S_APOSTROPHE}[kind]
            elif kind == STMD:
                out[kind, after] = S_SHORT
            else:
                out[kind, after] = S_LONG if (kind, after) in ((RV, EE), (ELL, ELL)) else S_LETTER
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at the symbol."""
    if symbol == S_NONE:
        return state, False
    if symbol in (S_LETTER, S_SHORT, S_LONG):
        if state == AFTER_APOSTROPHE and symbol != S_LETTER:
            return (BREAK if symbol == S_SHORT else IN_SUFFIX), False
        if state == IN_SUFFIX:
            return BREAK, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if symbol == S_OTHER:
        return IN_OTHERS, state not in (IN_OTHERS, AFTER_SPACE, AFTER_APOSTROPHE)
    if symbol == S_APOSTROPHE:
        joins = state in (IN_OTHERS, AFTER_SPACE, AFTER_APOSTROPHE)
        return (IN_OTHERS if joins else AFTER_APOSTROPHE), not joins
    if symbol == S_RUN:
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if symbol == S_SPACE else BREAK), True


@lru_cache(maxsize=1)
def automaton() -> dict[str, np.ndarray]:
    """Symbols by class pair; transitions; starts; functions of the symbols and their compositions.

    Symbols 10 to 19 are the same at the first code point of a text, which forgets the state before.
    """
    step = np.zeros((20, 8), np.uint8)
    start = np.zeros((20, 8), bool)
    for symbol in range(20):
        for state in range(8):
            step[symbol, state], start[symbol, state] = _step(BREAK if symbol >= 10 else state, symbol % 10)
    known = {tuple(range(8)): 0}
    for symbol in range(20):
        known.setdefault(tuple(step[symbol].tolist()), len(known))
    todo = list(known)
    generators = list(known)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    functions = np.array(list(known), np.uint8)
    compose = np.zeros((len(known), len(known)), np.uint8 if len(known) <= 256 else np.uint16)
    for f, i in known.items():
        for g, j in known.items():
            compose[i, j] = known[tuple(g[x] for x in f)]
    of = np.array([known[tuple(step[s].tolist())] for s in range(20)], compose.dtype)
    return {"symbols": _symbols(), "step": step, "start": start, "functions": functions, "compose": compose, "of": of}


def starts(text: str, lengths: np.ndarray) -> np.ndarray:
    """Where pieces start in the concatenation of texts of so many code points each."""
    a = automaton()
    if not text:
        return np.zeros(0, np.int64)
    classes = class_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    ends = np.cumsum(lengths[lengths > 0])
    after = np.append(classes[1:], END)
    after[ends - 1] = END
    symbols = a["symbols"][classes, after]
    symbols[np.append(0, ends[:-1])] += 10
    n = len(symbols)
    lanes = -(-n // LANE)
    columns = np.full(lanes * LANE, S_NONE, np.uint8)
    columns[:n] = symbols
    columns = np.ascontiguousarray(columns.reshape(lanes, LANE).T)
    size = len(a["compose"])
    compose, of = a["compose"].ravel(), a["of"]
    whole = of[columns[0]].astype(np.intp)
    for row in columns[1:]:
        whole = compose[whole * size + of[row]].astype(np.intp)
    # Inclusive scan over the lanes, by doubling: whole[i] becomes the composition of lanes 0 to i.
    shift = 1
    while shift < lanes:
        whole = np.concatenate([whole[:shift], compose[whole[:-shift] * size + whole[shift:]]]).astype(np.intp)
        shift *= 2
    state = np.append(np.uint8(BREAK), a["functions"][whole[:-1], BREAK]).astype(np.intp)
    step, start = a["step"].ravel(), a["start"].ravel()
    out = np.empty((LANE, lanes), bool)
    for i, row in enumerate(columns):
        at = row.astype(np.intp) * 8 + state
        out[i] = start[at]
        state = step[at].astype(np.intp)
    return np.flatnonzero(out.T.ravel()[:n])


class RankEncoder:
    """Encoder and decoder of one rank file; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.none = size
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.none)

    def _merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece: in each round each piece merges its leftmost pair of the lowest rank."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done: list[bytes] = [b""] * len(pieces)
        rank = np.full(len(ids), self.none)
        same = owner[:-1] == owner[1:]
        rank[:-1][same] = self._pair_rank(ids[:-1][same], ids[1:][same])
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            live = least < self.none
            counts = np.diff(np.append(first, len(ids)))
            if not live.all():
                raw = ids.astype("<u4").tobytes()
                over = np.flatnonzero(~live)
                for piece, a, n in zip(owner[first[over]].tolist(), first[over].tolist(), counts[over].tolist(), strict=True):
                    done[piece] = raw[4 * a : 4 * (a + n)]
                keep = np.repeat(live, counts)
                ids, owner, rank = ids[keep], owner[keep], rank[keep]
                if not len(ids):
                    break
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                least, counts = least[live], counts[live]
            hit = np.flatnonzero(rank == np.repeat(least, counts))
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]
            ids[hit] = least
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))  # places of the merged ids afterwards
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            for place in (at, at[at > 0] - 1):
                right = np.minimum(place + 1, len(ids) - 1)
                joined = (place + 1 < len(ids)) & (owner[place] == owner[right])
                rank[place] = np.where(joined, self._pair_rank(ids[place], ids[right]), self.none)
        return done

    def _merge_long(self, piece: bytes) -> bytes:
        """The same for one piece, with a heap of pairs over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, pairs = [*range(1, n), -1], [*range(-1, n - 1)], self.pairs
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((i, after[i]), (before[i], i)):
                if x >= 0 and y >= 0 and (r := pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        raw = [x.encode() for x in new]
        in_one = [self.ranks.get(x) for x in raw]
        short = [i for i, x in enumerate(raw) if in_one[i] is None and len(x) <= SHORT]
        merged = dict(zip(short, self._merge_short([raw[i] for i in short]), strict=True)) if short else {}
        for i, text in enumerate(new):
            one = in_one[i]
            self.cache[text] = one.to_bytes(4, "little") if one is not None else merged[i] if i in merged else self._merge_long(raw[i])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        whole = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = starts(whole, lengths)
        cuts = [*at.tolist(), len(whole)]
        pieces = [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        if len(self.cache) > CACHE_ENTRIES:
            self.old, self.cache = self.cache, {}
        new = []
        for piece in set(pieces).difference(self.cache):
            if (ids := self.old.get(piece)) is None:
                new.append(piece)
            else:
                self.cache[piece] = ids
        self._learn(new)
        ids = [*map(self.cache.__getitem__, pieces)]
        ends = np.searchsorted(at, np.cumsum(lengths)).tolist()
        for piece in new:
            if len(piece) > CACHED_CHARS:
                del self.cache[piece]
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def token_ends(self, ids: bytes) -> np.ndarray:
        """Byte offset in the text at which each token ends."""
        return np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])

    def decode(self, ids: bytes, ends: np.ndarray) -> bytes:
        """The bytes of the tokens, each put where the offsets retained at encoding say."""
        at, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(at), 1 << 16):
            part, own = at[k : k + (1 << 16)], ends[k : k + (1 << 16)].astype(np.int64)
            first = int(ends[k - 1]) if k else 0
            size = np.diff(own, prepend=first)
            if not np.array_equal(size, self.sizes[part]):
                raise ValueError("the offsets are not those of these tokens")
            out.append(self.bytes[np.repeat(self.offsets[part] - own + size, size) + np.arange(first, own[-1])].tobytes())
        return b"".join(out)

    def decode_range(self, ids: bytes, ends: np.ndarray, begin: int, end: int) -> bytes:
        """Bytes ``begin`` to ``end`` of the text, from the tokens that the offsets place there alone."""
        a, b = np.searchsorted(ends, begin, side="right"), np.searchsorted(ends, end, side="left") + 1
        first = int(ends[a - 1]) if a else 0
        some = self.decode(ids[4 * a : 4 * b], np.asarray(ends[a:b], np.int64) - first)
        return some[begin - first : max(begin, end) - first]


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> RankEncoder:
    """One encoder for each worker process and rank file."""
    return RankEncoder(path)


def encode_documents(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids (little-endian u32) and ends (byte offset of each token's end, u64)."""

    def make():
        encoder = rank_encoder(ranks)

        def work(keys, texts):
            ids = encoder.encode(texts)
            return {"doc_id": keys, "ids": ids, "ends": [encoder.token_ends(x).astype("<u8").tobytes() for x in ids]}

        return work

    return map_texts(texts_only(docs), make, "doc_id long, ids binary, ends binary")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id and text of a table (doc_id, ids, ends), by the offsets kept with the ids."""

    def make():
        encoder = rank_encoder(ranks)
        return lambda keys, ids: {"doc_id": [k["doc_id"] for k in keys], "text": [encoder.decode(x, np.frombuffer(k["ends"], "<u8")).decode() for k, x in zip(keys, ids, strict=True)]}

    return map_texts(encoded.select(F.struct("doc_id", "ends").alias("key"), "ids"), make, "doc_id long, text string", column="ids")


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the bytes decoded from them."""

    def make():
        encoder = rank_encoder(ranks)

        def work(keys, texts):
            ids = encoder.encode(texts)
            return {
                "doc_id": keys,
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(encoder.decode(x, encoder.token_ends(x))).hexdigest() for x in ids],
            }

        return work

    return map_texts(texts_only(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
