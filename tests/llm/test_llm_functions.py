"""The operators' plain functions against definitions and libraries."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from fixture_texts import texts
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from tidemark.llm import byte_bpe, chat, html_extract, labelled_pages, media, packing, quality, secret_scan, simhash, token_binary, token_ids, toxicity

TEXTS = [t or "" for t in texts()]
BPE, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    return token_ids.WordEncoder(BPE)


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.RankEncoder(RANKS)


ODD = st.text(st.sampled_from(list("ab stmdrvle'.,$ \n\t\u0085 é日12²ªḰ")), max_size=40)
SPECIAL = st.lists(st.sampled_from([*"ab \n.é<|", "  ", "<|endoftext|>", "word"]), max_size=14).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_word_encoder_equals_the_library(words, parts):
    got = words(parts)
    assert [np.frombuffer(x, words.dtype).tolist() for x in got] == [e.ids for e in words.tokenizer.encode_batch(parts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(SPECIAL)
def test_special_tokens_are_read_as_the_library_reads_them(words, text):
    from tokenizers import Tokenizer

    assert np.frombuffer(words([text])[0], words.dtype).tolist() == Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids
    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    assert np.frombuffer(token_ids.word_encoder(BPE, True)([text])[0], words.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_rank_encoder_equals_the_library(ranks, parts):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    got = ranks.encode(parts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(x) for x in parts]
    assert [ranks.decode(x, ranks.token_ends(x)) for x in got] == [x.encode() for x in parts]
    for ids, raw in zip(got, (x.encode() for x in parts), strict=True):
        for a in range(0, len(raw), 3):
            assert ranks.decode_range(ids, ranks.token_ends(ids), a, a + 5) == raw[a : a + 5]


def test_encoders_on_whole_texts(words, ranks):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    for text, a, b in zip(TEXTS, words(TEXTS), ranks.encode(TEXTS), strict=True):
        assert np.frombuffer(a, words.dtype).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b, "<u4").tolist() == library.encode_ordinary(text)
        ends = ranks.token_ends(b)
        assert (int(ends[-1]) if len(ends) else 0) == len(text.encode())


def test_long_piece_merges_as_short_ones(ranks):
    for piece in (b"ab" * 20, b"aaaaaaaaaaaaaaaaaaaa", "日本語".encode() * 4):
        assert ranks._merge_long(piece) == ranks._merge_short([piece])[0]


def test_huffman_is_optimal_within_its_limit_and_round_trips():
    rng = np.random.default_rng(3)
    for n, limit in ((1, 16), (2, 16), (5, 3), (300, 9), (3000, 16)):
        counts = np.zeros(n + 7, np.int64)
        counts[:n] = (rng.pareto(0.5, n) * 10 + 1).astype(np.int64)
        lengths = token_binary.code_lengths(counts, limit)
        assert lengths[n:].max() == 0 and lengths.max() <= limit
        assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
        codes = token_binary.canonical_codes(lengths)
        ids = rng.choice(n, 1000)
        payload, marks = token_binary.encode_block(ids, codes, lengths)
        table = token_binary.decode_table(lengths, limit)
        assert token_binary.decode_block(payload, marks, len(ids), table, limit).tolist() == ids.tolist()


def test_huffman_equals_unlimited_when_the_limit_is_loose():
    import heapq

    counts = np.array([45, 13, 12, 16, 9, 5, 1, 1])
    heap, total = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert int((counts * token_binary.code_lengths(counts)).sum()) == total


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in TEXTS:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("size", [1, 3, 50])
def test_wide_index_equals_all_pairs(size):
    rng = random.Random(size)
    fps = {rng.getrandbits(256) for _ in range(size)}
    for f in list(fps):
        for _ in range(4):
            for _ in range(rng.randint(0, 30)):
                f ^= 1 << rng.randrange(256)
            fps.add(f)
    fps = sorted(fps)
    words = np.array([[f >> 64 * (3 - i) & (1 << 64) - 1 for i in range(4)] for f in fps], np.uint64)
    got = simhash.GrayIndex(words, np.zeros(len(fps), np.int64)).components(38)
    pairs = set(zip(components(fps, 38), got.tolist(), strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def components(fps, limit=3):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("size", [1, 2, 7, 33, 400])
def test_gray_index_equals_all_pairs(size):
    rng = random.Random(size)
    fps = {rng.getrandbits(64) for _ in range(size)}
    for f in list(fps):
        for _ in range(rng.randint(0, 6)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    got = simhash.GrayIndex(np.array(fps, np.uint64), np.zeros(len(fps), np.int64)).components()
    pairs = set(zip(components(fps), got.tolist(), strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_gray_rank_is_the_inverse_of_the_code():
    n = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ n >> np.uint64(1)) == n).all()


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(triples)
    covered = {j for i, t in enumerate(triples) if seen[t] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_quality_counts():
    for text in TEXTS:
        assert quality.counts(text)[:5] == slow_counts(text)


def test_em_separates_junk_from_prose():
    prose = [t for t in TEXTS[:40] if len(t.split()) > 30]
    junk = [" ".join(w + "$$$" for w in t.split()) for t in prose[:12]]
    table = dict(zip(quality.COUNTS, np.array([quality.counts(t) for t in prose + junk]).T, strict=True))
    votes = quality.votes(table)
    ids, inverse, n = np.unique(quality.combination(votes), return_inverse=True, return_counts=True)
    model = quality.fit(ids, n)
    cast = ids[:, None] // 3 ** np.arange(len(quality.RULES)) % 3
    bad = quality.posterior_bad(cast, model["prior_bad"], model["chance"])[inverse]
    assert (bad[: len(prose)] < 0.5).all() and (bad[len(prose) :] > 0.5).all()
    assert quality.fit(np.zeros(0, np.int64), np.zeros(0))["prior_bad"] > 0


def slow_base(text):
    spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_spans():
    more = ["password: token: abcdef", "AKIA" * 8, "tokentoken=abcdefg secret='123456'", "0" * 23 + " " + "a" * 24]
    for text in TEXTS + more:
        assert [s for s in secret_scan.scan(text) if s[0] != "novel"] == slow_base(text)
    novel = secret_scan.scan("bearer Zk9xQ4vLm2TtY8pWc5RbN1sD7 end")
    assert novel == [("novel", 7, 32)]
    for plain in ("the key is config_default_timeout_value2 ok", "key " + "z" * 24 + "1", "Zk9xQ4vLm2TtY8pWc5RbN1sD7 with nothing before"):
        assert secret_scan.scan(plain) == []
    text = 'a token = "abcdefgh" b'
    assert secret_scan.redact(text, secret_scan.scan(text)) == 'a [SECRET]" b'


@pytest.mark.parametrize("seed", range(4))
def test_bins_hold_all_and_are_few(seed):
    rng = random.Random(seed)
    sizes = [min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(rng.choice([1, 30, 800]))]
    counts = [0] * 101
    for s in sizes:
        counts[s] += 1
    used, bins = Counter(), 0
    for times, combination in packing.fill_bins(counts, 100):
        assert sum(n * k for n, k in combination) <= 100
        bins += times
        for n, k in combination:
            used[n] += times * k
    assert used == Counter(sizes)
    assert bins <= sum(sizes) / 100 * 1.12 + 1


def test_fullest_is_the_best_subset():
    rng = random.Random(9)
    for _ in range(200):
        left = [0] * 31
        for _ in range(rng.randint(0, 6)):
            left[rng.randint(1, 30)] += 1
        items = [n for n, k in enumerate(left) for _ in range(k)]
        space = rng.randint(0, 30)
        best = max(s for m in range(1 << len(items)) if (s := sum(x for i, x in enumerate(items) if m >> i & 1)) <= space)
        taken = packing._fullest(left, space)
        assert sum(n * k for n, k in taken.items()) == best and all(k <= left[n] for n, k in taken.items())


def test_region_is_the_maximum_sum():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = rng.normal(size=rng.integers(1, 20))
        a, b = html_extract.best_region(x)
        best = max(x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1))
        assert x[a:b].sum() == pytest.approx(max(best, 0))


def test_pages():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>'</script><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- x -->"
        "<div class='ad'>Buy</div><article><h1>T &amp; U</h1><p><b>one two three<br><p>four  five\nsix &lt;b&gt; seven eight</p><form>mail</form><p>Nine.</p></article>"
        "<div id='comments'><p>first! what a nice text this is</p></div><footer>&copy; me</footer></body></html>"
    )
    assert html_extract.main_text(page) == "T & U\none two three\nfour five six <b> seven eight\nNine."
    for empty in ("", "<p>", "<nav>menu</nav>", "<!-- -->", "<script>x"):
        assert html_extract.main_text(empty) == ""
    assert html_extract.main_text("just text") == "just text"


def test_wrappers_do_not_silence_their_article():
    for wrap in ("<div class='has-sidebar'>{}</div>", "<div id=page class='with-header'>{}</div>", "<section class='share-wrap'>{}</section>", "<form id=all>{}</form>"):
        page = "<body>" + wrap.format("<article><h1>A day out</h1><p>we went to the lake and stayed there until it was dark</p><p>it was fine.</p></article>") + "<footer>all of it ours</footer>"
        assert html_extract.main_text(page) == "A day out\nwe went to the lake and stayed there until it was dark\nit was fine."


def test_links_and_breaks_inside_of_blocks():
    page = "<body><article><p><a href=1>Many people</a> came to see the new bridge,<br>and <a href=2>they</a> stayed &lt;long&gt;.</p><ul><li><a href=3>up</a></li><li><a href=4>down</a></li></ul></article>"
    assert html_extract.main_text(page) == "Many people came to see the new bridge, and they stayed <long>."


def plain(page):
    for mark in ("[[", "]]", "{{", "}}"):
        page = page.replace(mark, "")
    return page


def test_labelled_pages_are_told_from_the_others():
    """Fitted on all, every page comes out as labelled; fitted on the others, nearly all of its article does."""
    pages, precision = labelled_pages.PAGES, []
    for i, page in enumerate(pages):
        read, inside = html_extract._labels(page)
        truth = Counter(w for t, label in zip(read.texts, inside, strict=True) if label for w in t.split())
        assert Counter(html_extract.main_text(plain(page)).split()) == truth
        got = Counter(html_extract.main_text(plain(page), html_extract.weights(pages[:i] + pages[i + 1 :])).split())
        assert (got & truth).total() >= 0.95 * truth.total()
        precision.append((got & truth).total() / got.total())
    assert sum(precision) / len(precision) > 0.7


def test_the_scan_decides(monkeypatch):
    """Starting from one word's block alone, or from weights of nothing, gives other texts."""
    pages = [plain(p) for p in labelled_pages.PAGES]
    full = [html_extract.main_text(p) for p in pages]
    monkeypatch.setattr(html_extract, "best_region", lambda scores: (int(scores.argmax()), int(scores.argmax()) + 1))
    assert sum(html_extract.main_text(p) == t for p, t in zip(pages, full, strict=True)) <= 2
    monkeypatch.undo()
    flat = {k: (1.0 if not k.startswith("tag") else v) for k, v in html_extract.weights().items() if k in ("word", "link") or k.startswith("tag")}
    assert not any(html_extract.main_text(p, flat) == t for p, t in zip(pages, full, strict=True) if "<article>" in p)


def test_pages_of_the_smallest_tables():
    """The articles that a pattern finds in these pages, which all mark them by one element."""
    import html

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1])
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
        assert html_extract.main_text(page) == "\n".join(b for b in blocks if b)


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    began = time.time()
    deep = "<div class=x><b>" * 40_000 + "<p>some words stand here in the very middle of it all, as they do" + "</b></div>" * 40_000
    assert html_extract.main_text(deep).startswith("some words")
    assert len(html_extract.main_text("<p>words of a long page that goes on and on, as it seems.<i>" * 40_000)) > 1_000_000
    assert html_extract.main_text("<p>" * 100_000 + "</div>" * 100_000 + "<li><td>" * 50_000) == ""
    assert time.time() - began < 30


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(list("<>/apdiv \"'=!-&;#x1")), max_size=80))
def test_broken_pages_never_fail(page):
    html_extract.main_text(page)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(list("#</turn>\\hln \nab")), max_size=40), st.text(st.sampled_from(list("#\\n\nuser")), max_size=9))
def test_turns_read_back(text, role):
    written, a, b = chat.format_turn(role, text)
    assert chat.parse(written * 2) == [(role, text)] * 2
    assert chat.unescape(written[a:b]) == text
    assert "###" not in written[4:] and written.count("</turn>") == 1


def slow_fingerprints(samples):
    """Spectral peaks and their pairs by the definition, frame by frame."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    frames = max(1, -(-(len(x) - 256) // 128) + 1)
    x = np.pad(x, (0, max(0, (frames - 1) * 128 + 256 - len(x))))
    power = [np.abs(np.fft.rfft(x[k * 128 : k * 128 + 256] * np.hanning(256).astype(np.float32))) ** 2 for k in range(frames)]
    edges, peaks = (2, 12, 28, 60, 128), []
    for k in range(frames):
        for a, b in zip(edges, edges[1:], strict=False):
            own = power[k][a:b].max()
            before, after = (power[j][a:b].max() if 0 <= j < frames else -1 for j in (k - 1, k + 1))
            if own > before and own >= after and own > 1:
                peaks.append((k, a + int(power[k][a:b].argmax())))
    pairs = [(t, f << 13 | g << 6 | u - t) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 4] if u - t <= 63]
    pairs.sort()
    return [h for _, h in pairs], [t for t, _ in pairs], len(peaks)


def test_media_is_lossless_and_fingerprints_know_tones():
    for text in TEXTS:
        samples = media.payload(text)
        assert len(samples) % 64 == 0 and samples and samples.rstrip(b"\0") == text.encode().rstrip(b"\0")
        assert media.from_wav(media.to_wav(samples)) == samples
    t = np.arange(4096)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 / 256 * t) * (t % 1024 < 512)).astype(np.uint8).tobytes()
    bins, _ = media.band_peaks(tone)
    assert Counter(bins[:, 1].tolist()).most_common(1)[0][0] == 20
    hashes, frames, peaks = media.fingerprint(tone)
    assert (hashes.tolist(), frames.tolist(), peaks) == slow_fingerprints(tone)
    assert len(hashes) == len(frames) > 0 and (np.diff(frames) >= 0).all()
    whole = media.band_peaks(tone * 40)
    assert len(whole[0]) == (len(tone) * 40 - 256) // 128 + 1


def test_toxic_dictionary_holds_what_toxic_texts_share(spark):
    rows = [(1, t) for t in TEXTS if "scumbag" in t] + [(0, t) for t in TEXTS[:40]]
    ordinary, extra = toxicity.dictionaries(spark.createDataFrame(rows, "toxic int, text string"))
    assert b"scumbag" in extra and b"scumbag" not in ordinary
    d = toxicity.Distance(ordinary, extra)
    assert d(b"scumbag") > 2 and d(b"bacedi") <= 2
    assert d.features("")[0] == 0


def test_contexts_of_words(spark):
    rows = [(1, "a b a b. A"), (1, "a b"), (0, "c b, a"), (0, "")]
    want = Counter()
    for toxic, pairs in ((1, {(b"", b"a"), (b"a", b"b"), (b"b", b"a")}), (0, {(b"", b"c"), (b"c", b"b"), (b"b", b"a")})):
        for _, word in pairs:
            want[word, toxic] += 1
    got = {bytes(r.word): (r.t, r.o) for r in toxicity._word_contexts(spark.createDataFrame(rows, "toxic int, text string")).collect()}
    assert got == {w: (want[w, 1], want[w, 0]) for w, _ in want}


def test_trainer_takes_what_it_can_get():
    assert toxicity.trained([]) == b"" and toxicity.trained([(b"ab", 3)]) == b"ab "
    many = [(f"word{i}".encode(), 50 - i) for i in range(40)]
    assert toxicity.trained(many) == toxicity.trained(many) and b"word0" in toxicity.trained(many)


def test_ranks_file_reads_as_its_tokens(ranks):
    first = open(RANKS, "rb").readline().split()
    assert ranks.tokens[int(first[1])] == base64.b64decode(first[0])
    assert hashlib.sha256(ranks.decode(ranks.encode(["x y"])[0], np.array([1, 3]))).digest() == hashlib.sha256(b"x y").digest()
