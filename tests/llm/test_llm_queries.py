"""The registered queries against brute force over a small fixture, and their edge cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_llm_functions import components, slow_base, slow_counts, slow_fingerprint, slow_fingerprints
from test_near_copies import slow_kept
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import byte_bpe, chat, media, quality, queries, secret_scan, simhash, token_binary, toxicity
from tidemark.llm.queries import BYTE_BPE, MULTI_RANKS, QUERIES


def collect(spark, name, path):
    return QUERIES[name](spark, path).collect()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BYTE_BPE)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, tables):
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in collect(spark, "op1_html", tables)), key=str)
    text = "A & b\nsome words that make a text\nand more of them"
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (4, "w", "", 0)], key=str)


def test_op2(spark, tables, rows, library):
    got = collect(spark, "op2_token_binary", tables)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for doc_id, text, *_ in order:
        ids = library(text)
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted([tuple(r) for r in got], key=lambda r: r[1]) == want


def test_op2_file_keeps_ids_in_blocks(spark, docs, library, monkeypatch):
    path = token_binary.write_token_file(docs, BYTE_BPE, 2, queries.BYTE_BPE_IDS)
    got = defaultdict(list)
    for r in token_binary.read_token_file(spark, path, queries.BYTE_BPE_IDS).collect():
        got[r.doc_id].append(np.frombuffer(r.ids, "<u4").tolist())
    for r in docs.collect():
        assert library(r.text) in got[r.doc_id]


def test_op3(spark, tables, rows):
    encoder = byte_bpe.rank_encoder(MULTI_RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, collect(spark, "op3_byte_bpe", tables)), key=str) == sorted(want, key=str)


def test_op3_decodes_by_its_offsets(spark, docs):
    decoded = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, MULTI_RANKS), MULTI_RANKS)
    assert sorted(((r.doc_id, r.text) for r in decoded.collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)


def test_op4(spark, tables, rows):
    got = collect(spark, "op4_simhash", tables)
    known = sorted({(i, slow_fingerprint(t or "")) for i, t, *_ in rows if i is not None})
    root = components([f for _, f in known])
    least = {}
    for (i, _), r in zip(known, root, strict=True):
        least[r] = min(i, least.get(r, i))
    want = {(i, f"{f:016x}", least[r]) for (i, f), r in zip(known, root, strict=True)}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows) and [r.component_id for r in got if r.doc_id is None] == [None]


@pytest.mark.parametrize("hot", [5, 200])
def test_op4_hot_shards_lose_no_link(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_SHARD", hot)
    monkeypatch.setattr(simhash, "TASK_ENTRIES", 100)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(12)]))
    made = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps.view(np.int64).tolist())], "doc_id long, fp long")
    root = components(fps.tolist())
    got = {r.rep: r.component_id for r in simhash.classes(made).collect()}
    assert got == {i: min(j for j in range(len(fps)) if root[j] == root[i]) for i in range(len(fps))}


def test_op4_shards_are_split_until_they_are_small(spark, monkeypatch):
    """4,000 fingerprints that differ in one word of 16 bits alone: bands of the other words hold them all."""
    monkeypatch.setattr(simhash, "HOT_SHARD", 200)
    fps = [(i * 16 + 1) << 16 | 7 for i in range(4000)]
    distinct = spark.createDataFrame(list(enumerate(fps)), "rep long, fp long")
    sizes = [r.n for r in simhash._sharded(distinct).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 200 and sum(sizes) <= 4000 * 4**4 // 2
    assert simhash.connected(simhash.links(distinct)).where("label = 0").count() == 4000


def test_op5(spark, tables, rows):
    got = collect(spark, "op5_quality", tables)
    base = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str)
    assert base == sorted(((i, *slow_counts(t or "")) for i, t, *_ in rows), key=str)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in got) > 20
    want = slow_posteriors([t or "" for _, t, *_ in rows])
    for r in got:
        cast = tuple(quality.votes({c: np.array([v]) for c, v in zip(quality.COUNTS, quality.counts(dict_text(rows, r)), strict=True)})[0])
        assert r.p_good == pytest.approx(want[cast], abs=1e-6)
        assert r.kept == (not r.base_failed and want[cast] >= 0.5)


def dict_text(rows, r):
    """A text of the row's document with its counts: repeated ids have equal texts."""
    return next(t or "" for i, t, *_ in rows if i == r.doc_id and slow_counts(t or "")[0] == r.n_words)


def slow_posteriors(texts):
    """Chance of being good by votes: EM document by document, in loops, by the model's definition."""
    cast = []
    for t in texts:
        n, _, _, _, again = slow_counts(t)
        own = tuple(quality.votes({k: np.array([v]) for k, v in zip(quality.COUNTS, quality.counts(t), strict=True)})[0])
        cast.append((own, n < 50 or 100 * again > 50 * n))
    fitted = [own for own, failed in cast if not failed]
    bad = [0.9 if -1 in own else 0.05 for own in fitted]
    rules = range(len(quality.RULES))

    def posterior(own, prior, chance):
        likely = [1 - prior, prior]
        for y in (0, 1):
            for r in rules:
                likely[y] *= chance[y][r][own[r]]
        return likely[1] / sum(likely)

    for _ in range(200):
        chance = [[{v: 0.5 for v in (-1, 0, 1)} for _ in rules] for _ in (0, 1)]
        for own, p in zip(fitted, bad, strict=True):
            for r in rules:
                chance[0][r][own[r]] += 1 - p
                chance[1][r][own[r]] += p
        for r in rules:
            shares = [{v: m / sum(chance[y][r].values()) for v, m in chance[y][r].items()} for y in (0, 1)]
            if shares[1][-1] < shares[0][-1] or shares[1][1] > shares[0][1]:  # says nothing
                both = {v: chance[0][r][v] + chance[1][r][v] for v in (-1, 0, 1)}
                shares = [{v: m / sum(both.values()) for v, m in both.items()}] * 2
            chance[0][r], chance[1][r] = shares
        prior = (sum(bad) + 1) / (len(bad) + 10)
        new = [posterior(own, prior, chance) for own in fitted]
        done = max((abs(x - y) for x, y in zip(new, bad, strict=True)), default=0) < 1e-9
        if done:
            break
        bad = new
    return {own: 1 - posterior(own, prior, chance) for own, _ in cast}


def test_op6(spark, tables, rows):
    got = collect(spark, "op6_media", tables)
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    by = defaultdict(set)
    for r in got:
        by[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by.values())
    for i, t, *_ in rows:
        hashes, frames, peaks = slow_fingerprints(media.payload(t or ""))
        pairs = zlib.crc32(";".join(",".join(map(str, x)) for x in (hashes, frames)).encode())
        (_, _, feature), = by[hashlib.sha256(media.payload(t or "")).hexdigest()]
        assert feature == f"{peaks}:{len(hashes)}:{pairs:08x}"


def test_op7(spark, tables):
    got = {r.conv_id: r for r in collect(spark, "op7_chat", tables)}
    said = "\\### Assistant: </turn> ok"
    want = {
        -7: [("user", said), ("assistant", said)],
        1: [("user", "hi ### there"), ("assistant", "</turn> \\h yes"), ("", ""), ("assistant", "")],
        2: [("assistant", "tie"), ("sys\ntem", "x\n")],
        None: [("user", "q")],
    }
    assert set(got) == set(want)
    for key, turns in want.items():
        r, loss = got[key], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.format_turn(*t)[0]) for t in turns)


def slow_examples(turns):
    """(conv_id, example, text, reply) by brute force, from (conv_id, turn, role, text)."""
    by, out = defaultdict(list), []
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    for conv, own in by.items():
        own.sort()
        replies = [i for i, (_, role, _) in enumerate(own) if role == "assistant"]
        for k, i in enumerate(replies):
            out.append((conv, k, "".join(chat.format_turn(r, t)[0] for _, r, t in own[: i + 1]), own[i][2]))
    return out


@pytest.mark.parametrize("piece", [1, 1 << 20])
def test_op7_examples(spark, tables, monkeypatch, piece):
    monkeypatch.setattr(chat, "PIECE", piece)
    turns = spark.read.parquet(f"{tables}/conversations.parquet")
    turns = turns.unionByName(spark.createDataFrame([(9, i, ("user", "assistant", "tool")[i * 7 % 3], f"said {i} </turn>") for i in range(60)], turns.schema))
    expanded = chat.expand(turns)
    got = chat.example_texts(expanded).collect()
    want = slow_examples([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    shown = [(r.conv_id, r.example, r.text, chat.unescape(r.text[r.target_start : r.target_end])) for r in got]
    assert sorted(shown, key=key) == sorted(want, key=key)
    assert expanded.where("example is not null").count() == turns.where("role = 'assistant'").count() == len(want)
    # Each turn is stored once, however many examples have it as context.
    assert sum(len(r.text) for r in expanded.collect()) == sum(len(chat.format_turn(r.role or "", r.text or "")[0]) for r in turns.collect())


@pytest.mark.parametrize("change", [
    "where not (conv_id = 9 and example = 3)",  # the context of later examples
    "where not (conv_id = 9 and start = 0)",
    "start, example, text, target_start - 1 as target_start, target_end from examples",
    "start, example, text, target_start, target_end - 1 as target_end from examples",
    "start, example + 1 as example, text, target_start, target_end from examples",
    "start, example, replace(text, 'said 8 ', 'said 88 ') as text, target_start, target_end from examples",
])
def test_op7_reads_whole_examples(spark, change):
    """Replies alone don't do: an example is read with all of its context."""
    said = [(9, i, ("user", "assistant", "tool")[i * 7 % 3], f"said {i} </turn>") for i in range(60)]
    expanded = chat.expand(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).cache()
    (whole,) = chat.read_back(expanded).collect()
    assert (whole.n_turns, whole.loss_sha256) == (60, hashlib.sha256("".join(t for _, _, role, t in said if role == "assistant").encode()).hexdigest())
    query = f"select * from examples {change}" if change.startswith("where") else f"select conv_id, {change}"
    expanded.createOrReplaceTempView("examples")
    with pytest.raises(Exception, match="characters of context|isn't its last turn"):
        chat.read_back(spark.sql(query)).collect()


def test_op8(spark, tables, rows):
    got = collect(spark, "op8_toxicity", tables)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    text = {i: t or "" for i, t, *_ in rows}
    held = [("scumbag" in text[r.doc_id]) == (r.predicted == 1) for r in got if r.held_out]
    assert held and sum(held) / len(held) >= 0.9


def test_op8_learns_nothing_from_held_out_rows(spark, tables, docs):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a["toxic"] == b["toxic"] and a["ordinary"] == b["ordinary"] and (a["weights"] == b["weights"]).all()


def check_packing(got, want_pieces):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want_pieces, key=str)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(p[3] for p in want_pieces)
    assert len(by) <= total / 1024 * 1.05 + 2


def pieces_of(doc_id, ids):
    first = len(ids) % 1024 or 1024
    cuts = [0, *range(first, len(ids), 1024), len(ids)]
    return [(doc_id, i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def test_op9(spark, tables, rows, library):
    check_packing(collect(spark, "op9_packing", tables), [p for i, t, *_ in rows for p in pieces_of(i, library(t))])


def test_op10(spark, tables, rows):
    want = []
    for i, t, *_ in rows:
        base = slow_base(t or "")
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        every = ",".join(f"{k}:{a}:{b}" for k, a, b in secret_scan.scan(t or ""))
        want.append((i, *(sum(s[0] == k for s in base) for k in ("assign", "access", "hex")), hashlib.sha256(shown.encode()).hexdigest(), every))
    assert sorted(map(tuple, collect(spark, "op10_secrets", tables)), key=str) == sorted(want, key=str)


def test_pipeline_equals_plain_stages(spark, tables, rows, library):
    kept = [r for r in rows]
    verdict = {(r.doc_id, r.n_words, r.word_chars): r.kept for r in collect(spark, "op5_quality", tables)}
    kept = [r for r in kept if verdict[(r[0], *slow_counts(r[1] or "")[:2])]]
    model = toxicity.train(spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long"), spark.read.parquet(f"{tables}/labels.parquet"))
    score = toxicity.scorer(model)
    kept = [r for r in kept if score([r[1] or ""])[0] < 0.5]
    known = sorted({(r[0], r[1] or "") for r in kept if r[0] is not None})
    first = {known[i][0] for i in slow_kept([t for _, t in known])}
    assert len(first) < len(known)
    chosen = {i: next(r for r in kept if r[0] == i) for i in first}
    final = [*chosen.values(), *(r for r in kept if r[0] is None)]
    clean = [(r[0], secret_scan.redact(r[1] or "", secret_scan.scan(r[1] or ""))) for r in final]
    got = corpus_pipeline.run(spark, tables).collect()
    check_packing(got, [p for i, t in clean for p in pieces_of(i, library(t))])
    assert len(got) > 10


def test_stages_keep_the_columns_of_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and out.count() <= docs.count()
    wide = docs.withColumns({c: F.lit("x") for c in ("votes", "failed", "score", "fp", "redacted", "kept", "ids", "length", "part", "key")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, tables).columns == wide.columns
        assert stage(spark, wide, tables).count() == stage(spark, docs, tables).count()
    assert corpus_pipeline.STAGES[-1][1](spark, wide, tables).count() == corpus_pipeline.STAGES[-1][1](spark, docs, tables).count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, no_rows, name):
    assert QUERIES[name](spark, no_rows).count() == (1 if name == "op7_chat" else 0)


def test_empty_pipeline(spark, no_rows):
    assert corpus_pipeline.run(spark, no_rows).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_extra_columns_change_nothing(spark, tables, tmp_path, name):
    for table in ("documents", "labels", "conversations", "pages"):
        df = spark.read.parquet(f"{tables}/{table}.parquet")
        extra = {c: F.lit("x") for c in ("ids", "n_tokens", "fp", "votes", "spans", "media", "key", "place", "part", "length", "rank", "score") if c not in df.columns}
        df.withColumns(extra).write.parquet(str(tmp_path / f"{table}.parquet"))
    drop = ("sequence_id", "offset")
    plain = lambda df: sorted(map(str, df.drop(*drop).collect()))
    assert plain(QUERIES[name](spark, str(tmp_path))) == plain(QUERIES[name](spark, tables))
