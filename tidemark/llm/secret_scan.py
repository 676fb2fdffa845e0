"""Secrets in texts: fixed patterns, and strings that compression can't explain from their surroundings.

The base patterns name a credential, an access key or a long hexadecimal run. The method adds strings
that stand in a sensitive context, after a word such as *auth*, *key* or *private* in the same line or
the one before, and are novel: each is compressed with zstandard behind the code around it, primed with a
dictionary of identifiers, and what it adds to the compressed length is held against what a random string of
the same length and alphabet adds in its place. Names, paths and repeated values are explained by the
dictionary or the surroundings; keys are not. A candidate may be of any length, and what adjoins one
that is looked at, with only line breaks or dots between, is looked at as well: lines of a key, parts of a token.

The dictionary is the corpus's own: identifiers that stand behind LEAST_CONTEXTS different words or more
in all documents, the most usual ones of them that fill DICTIONARY bytes, and a few words of code and
configuration before them. A key that is copied with its document gains no context by that.

Spans are in code points, end exclusive. Rows: a null or empty text has none; repeated rows have equal
spans.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, fresh, map_texts, steps, texts_only

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Runs of the least length or more: the runs themselves are as long as they can be.
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")

#: Words that make what follows sensitive.
_SENSITIVE = re.compile(
    r"(?:auth|bearer|credential|passphrase|password|passwd|pwd|private|secret|signature|signing|token|webhook|(?:access|api|account|encryption|client|deploy)[_ -]?(?:key|secret)|key)",
    re.IGNORECASE | re.ASCII,
)
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")
#: How far behind a sensitive word a candidate may begin, with one line break between at most; how much of the
#: code on either side may explain it; and its least share of what a random string adds.
CONTEXT, AROUND, NOVELTY = 240, 4096, 0.75
#: Identifiers: runs with an underscore, a digit behind a letter, or a capital behind a small letter.
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])(?=[A-Za-z]{0,40}_|[A-Za-z]{1,40}[0-9]|[A-Za-z]{0,40}[a-z][A-Z])[A-Za-z0-9_]{6,40}(?![A-Za-z0-9_])")
LEAST_CONTEXTS, DICTIONARY = 8, 16384
_PARTS, _WORD = re.compile(r"[^A-Za-z0-9]+"), re.compile(r"[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}")
_CAMEL = re.compile(r"(?:[A-Z]|(?<![A-Za-z]))[a-z]{2,}[0-9]{0,4}|(?<![A-Za-z0-9])[A-Z]{3,}[0-9]{0,4}(?![A-Za-z0-9])")
_VOWEL, _CONSONANTS = re.compile("[aeiouyAEIOUY]"), re.compile("[^aeiouyAEIOUY0-9]{5}")
#: What stands between the lines of a key or the parts of a token, and a last line too short for a candidate.
_JOIN = re.compile(r"(?:[.\\]|[ \t]*[\r\n]+[ \t]*)+")
_TAIL = re.compile(r"(?:[.\\]|[ \t]*[\r\n]+[ \t]*)+([A-Za-z0-9+/_-]{1,15}(?:={1,2}(?![A-Za-z0-9+/_=-])|(?=(?:\\[rn]|\s)*-----END)))")
#: Longer candidates are measured in chunks of this many characters, as well as whole.
CHUNK = 32

#: One of these is in every match of _ASSIGN, or of _SENSITIVE, in lower case: most texts have none, and
#: looking for a plain string is a hundred times as fast as matching.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_SENSITIVE_WORDS = (*_ASSIGN_WORDS[:-1], "auth", "bearer", "credential", "passphrase", "pwd", "private", "signature", "signing", "webhook", "key")
_HEX_MAP, _HEX_RUN = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256)), b"1" * 24

#: Identifiers and words of code, configuration and licences, for the dictionary.
IDENTIFIERS = (
    "abstract argument assert async await boolean break callback class client config configuration connection "
    "const constructor container context continue controller database default define delete description document "
    "element encoding environment error event exception export expected extends factory false filename final "
    "function handler header headers hostname identifier implements import include index initialize instance int "
    "integer interface iterator lambda length listener localhost logger manager message method module namespace "
    "none null number object options override package parameter parent password path payload pipeline private "
    "process production property protected protocol provider public query reference register repository request "
    "resource response result return schema secret select self server service session settings signature source "
    "static status string struct template test thread timeout timestamp token true type undefined update user "
    "username utils value variable version virtual void while worker https://www.example.com/index.html "
    "http://localhost:8080/api/v1/ /usr/local/lib/ /home/user/ /var/log/ application/json text/html utf-8 "
    "Copyright License Apache MIT Public Version 2.0 Permission is hereby granted without warranty of any kind "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 1234567890 EXAMPLE_KEY YOUR_API_KEY xxxxxxxx "
)


@lru_cache(maxsize=4)
def _coder(identifiers: bytes):
    import zstandard as zs

    content = IDENTIFIERS.encode() + identifiers
    how = zs.ZstdCompressionParameters.from_level(12, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
    held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zs.ZstdCompressor(dict_data=held, compression_params=how)


_ALPHABETS = ("0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEF", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _control(candidate: str) -> str:
    """A random string of the candidate's length over the smallest alphabet that has its letters and digits."""
    own, signs = {c for c in candidate if c.isalnum()}, {c for c in candidate if not c.isalnum()}
    whole = "".join(dict.fromkeys("".join(_ALPHABETS)))
    alphabet = next((a for a in ("0123456789", *_ALPHABETS) if own <= set(a)), whole) + "".join(sorted(signs))
    return "".join(random.Random(len(candidate)).choices(alphabet, k=len(candidate)))


def novelty(before: str, candidate: str, after: str, identifiers: bytes = b"") -> float:
    """Bytes that ``candidate`` adds to its surroundings, as a share of what a random string adds."""
    compress, close = _coder(identifiers).compress, bytes(range(12))
    around, whole, control = (len(compress((after + "\n" + before + x).encode() + close)) for x in ("", candidate, _control(candidate)))
    return (whole - around) / max(1, control - around)


def _named(text: str) -> bool:
    """Whether most of the string is words and numbers as names join them: those of one case by separators,
    others by capitals as well. Short words cost zstandard as much as random letters, so it can't tell."""
    if text[1:].islower() or text.isupper() or not any(map(str.isalpha, text)):
        own = sum(len(x) for x in _PARTS.split(text) if _WORD.fullmatch(x))
    else:
        own = sum(len(m[0]) for m in _CAMEL.finditer(text) if _VOWEL.search(m[0]) and not _CONSONANTS.search(m[0]))
    return 3 * own >= 2 * sum(map(str.isalnum, text))


def _novel(text: str, start: int, end: int, identifiers: bytes) -> list[tuple[int, int]]:
    """The spans of a candidate that are novel: all of it, or else those of its chunks."""

    def new(a: int, b: int) -> bool:
        return novelty(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND], identifiers) >= NOVELTY

    if new(start, end):
        return [(start, end)]
    if end - start < 2 * CHUNK:
        return []
    cuts = [*range(start, end - CHUNK + 1, CHUNK), end]
    cuts = cuts if cuts[-1] - cuts[-2] >= CHUNK else [*cuts[:-2], end]
    found = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if not _named(text[a:b]) and new(a, b)]
    return [(start, end)] if 2 * len(found) >= len(cuts) - 1 else found


class _Covered:
    """How much of a stretch spans cover, however many there are."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends, self.before, total = [], [], [], 0
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                total += max(0, b - self.ends[-1])
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)
                self.before.append(total)
                total += b - a

    def upto(self, x: int) -> int:
        i = bisect_left(self.starts, x) - 1
        return self.before[i] + min(x, self.ends[i]) - self.starts[i] if i >= 0 else 0

    def end_of(self, x: int) -> int:
        """Where what covers ``x`` ends; 0 if nothing does."""
        i = bisect_left(self.starts, x + 1) - 1
        return self.ends[i] if i >= 0 and self.ends[i] > x else 0

    def __call__(self, a: int, b: int) -> int:
        return self.upto(b) - self.upto(a)


def _chains(text: str, known: _Covered) -> list[list[tuple[int, int]]]:
    """For every sensitive word, the candidates within reach and what adjoins them, in runs that adjoin.

    A word that is part of a span known has its value there, and reaches no further than that.
    """
    places = [m.span() for m in _CANDIDATE.finditer(text)]
    starts, following, chains = [a for a, _ in places], 0, []
    for word in _SENSITIVE.finditer(text):
        i = max(bisect_left(starts, word.end()), following)
        reach = known.end_of(word.start()) or word.end() + CONTEXT
        while i < len(places) and starts[i] <= reach and text.count("\n", word.end(), starts[i]) < 2:
            chain = [places[i]]
            i += 1
            while i < len(places) and _JOIN.fullmatch(text, chain[-1][1], starts[i]):
                chain.append(places[i])
                i += 1
            chains.append(chain)
        following = max(following, i)
        if following == len(places):
            break
    return chains


def scan(text: str, identifiers: bytes = b"") -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start and then kind."""
    low = text.lower()
    found = []
    if any(w in low for w in _ASSIGN_WORDS):
        found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    if _HEX_RUN in text.encode("latin-1", "replace").translate(_HEX_MAP):  # a byte a code point
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if not any(w in low for w in _SENSITIVE_WORDS):
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))
    known = _Covered([(a, b) for _, a, b in found])
    # Only what stands within reach of a sensitive word is looked at.
    for chain in _chains(text, known):
        ends = 0
        for start, end in chain:
            base = known(start, end)
            spans = _novel(text, start, end, identifiers) if 2 * base < end - start and (ends or not _named(text[start:end])) else []
            found += [("novel", a, b) for a, b in spans]
            ends = end if base or spans else 0
        if len(chain) > 1 and ends and (tail := _TAIL.match(text, chain[-1][1])):
            found.append(("novel", tail.start(1), tail.end(1)))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for start, end in sorted((a, b) for _, a, b in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def corpus_identifiers(docs: DataFrame) -> bytes:
    """The identifiers that stand behind most different words in all documents, the most usual last, where
    matches cost least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            pairs = set()
            for text in batch.column(1).to_pylist():
                for m in _IDENTIFIER.finditer(text):
                    pairs.add((m[0], zlib.crc32(text[max(0, m.start() - 16) : m.start()].encode())))
            pairs = [*pairs]
            for k in range(0, len(pairs), 1 << 16):
                names, before = zip(*pairs[k : k + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(before, pa.int64())], names=["name", "before"])

    pairs = texts_only(docs).mapInArrow(run, "name string, before long").distinct()
    usual = pairs.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_CONTEXTS)
    # Each takes seven bytes at least with its space, so more of them can't be in the dictionary.
    names = [r.name for r in usual.orderBy(F.desc("n"), "name").limit(DICTIONARY // 7).collect()]
    out, total = [], 0
    for name in names:
        if total + len(name) + 1 > DICTIONARY:
            break
        out.append(name)
        total += len(name) + 1
    return "".join(x + " " for x in reversed(out)).encode()


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), of every row of ``docs``."""
    identifiers = corpus_identifiers(docs)

    def make():
        def work(keys, texts):
            return {"doc_id": keys, "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, identifiers)] for t in texts]}

        return work

    return map_texts(texts_only(docs), make, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redact_all(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark, and ``n_chars``, if there is one, brought up to date."""
    name, identifiers = fresh(docs, "redacted"), corpus_identifiers(docs)

    def make():
        def work(keys, texts):
            spans = [scan(t, identifiers) for t in texts]
            return {name: [redact(t, s) if s else None for t, s in zip(texts, spans, strict=True)]}

        return work

    new = F.col(name)
    out = {"text": F.coalesce(new, "text"), "n_chars": F.when(new.isNotNull(), F.length(new)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return append(docs, make, {name: "string"}).select(*(out[c].cast(docs.schema[c].dataType).alias(c) if c in out else c for c in docs.columns))


def joined(spans, kinds: tuple[str, ...] = KINDS):
    """A column of kind:start:end, comma-joined, of the spans of ``kinds``."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
