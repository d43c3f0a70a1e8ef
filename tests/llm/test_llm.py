"""Operators on training data against plain versions, on small tables with nulls, empty texts, copies and odd rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from changefeed.llm import bpe, licences, mixing, neighbours, quality, repeats, simhash, tokens, toxicity, warc
from changefeed.llm.pieces import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, words string, h long"
TIKTOKEN, JSON = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))


def documents(seed: int = 5, n: int = 60) -> list[tuple]:
    """Random prose with copies, near copies, shared passages, nulls, repeated rows and odd texts."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeéü", k=rnd.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rnd.choices(vocabulary, k=40))
    texts: list[str | None] = [" ".join(rnd.choices(vocabulary, k=rnd.randint(25, 120))) for _ in range(n)]
    for i in range(0, n, 7):
        words = texts[i + 1].split(" ") if i + 1 < n else ["x"]
        at = rnd.randrange(len(words))
        texts[i] = " ".join([*words[:at], passage, *words[at:]])
    texts += [texts[3], texts[3] + " more", texts[4] + "\n" + texts[4], None, "", " \t\n ", "one", "two words", "a" * 20_000]
    texts += ["Licensed under the Apache License, Version 2.0.\nX", "the MIT  License; general\npublic license", "don't  stop\n\n  now\u00a0x "]
    rows = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["b", "a", None]), None, "x", "y", 1) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, texts[5], "en", "a", 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([], SCHEMA)


def ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))


def same(got, want) -> None:  # noqa: ANN001
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_every_operator_takes_an_empty_table(spark, empty):  # noqa: ANN001
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    frames = [
        bpe.digests(empty, TIKTOKEN, public_tokenizers.PATTERN), simhash.near_duplicates(empty), toxicity.scored(empty, labels),
        neighbours.search(vectors, F.col("vec_id") % 2 == 0, 3), tokens.token_files(empty, JSON, 2), mixing.taken(mixing.mix_documents(empty)),
        quality.judged(empty), warc.converted(pages), repeats.digests(empty), licences.scan(empty),
    ]
    assert [f.count() for f in frames] == [0] * 10
    assert [f(spark, empty, "").count() for _, f in corpus_pipeline.STAGES] == [0] * 5


def test_pieces_keep_the_matches_of_the_pattern():
    import regex

    pattern, rnd = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choices(["a", "é", "7", " ", " ", "\n", "\t", "'s", ".", "\u00a0", "\x1c", "\0", "b c"], k=rnd.randint(0, 14)))
        assert "".join(cut(text)) == text
        assert [m for x in cut(text) for m in pattern.findall(x)] == pattern.findall(text)


def test_bpe_equals_the_public_library_and_decodes(docs):  # noqa: ANN001
    ranks = bpe.read_ranks(TIKTOKEN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in documents():
        ids = library.encode_ordinary(r[1] or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((r[0], len(ids), digest, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    same(bpe.digests(docs, TIKTOKEN, public_tokenizers.PATTERN).collect(), want)
    back = bpe.decode(bpe.encode(docs, TIKTOKEN, public_tokenizers.PATTERN), TIKTOKEN, public_tokenizers.PATTERN)
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in back.select("text", "bytes").collect())


def test_long_words_equal_the_public_library(monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(bpe, "ROWS_OF_LONG", 20_000)  # the recursion stops and goes on
    ranks, rnd = bpe.read_ranks(TIKTOKEN), random.Random(7)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["".join(rnd.choices(a, k=k)) for a in ("ab", "aeinst", "étaü", "=-") for k in (255, 256, 257, 400, 1500)]
    texts += ["a" * 5001, "ab" * 2000, "=" * 3000, " " * 900 + "x", " ".join(texts)]
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    ids = list(codec.encode(texts))
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert list(codec.decode(ids)) == [t.encode() for t in texts]


def test_special_strings_are_text_to_the_ranks_and_tokens_to_the_library(spark):  # noqa: ANN001
    text = "<|endoftext|> x<|endoftext|>"
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert bpe.digests(one, TIKTOKEN, public_tokenizers.PATTERN).first().n_tokens > 4
    assert tokens.token_files(one, JSON, 2).first().n_tokens == 4  # the library alone gives the two added tokens, " x" and the end


def fingerprint(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps: list[int], ids: list[int | None]) -> list[int | None]:
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if new == label:
            break
        label = new
    best: dict[int, int] = {}
    for g, i in zip(label, ids):
        if i is not None:
            best[g] = min(i, best.get(g, i))
    return [best.get(g) for g in label]


def test_simhash_equals_all_pairs(docs):  # noqa: ANN001
    rows = documents()
    fps = [fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{f:016x}", g) for r, f, g in zip(rows, fps, groups(fps, [r[0] for r in rows]))]
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(F.col("fp")), "component_id")
    same(found.collect(), want)


@pytest.mark.parametrize("long_list", [1, 256])
def test_index_finds_every_link_in_dense_groups(spark, long_list):  # noqa: ANN001
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(50)}
    for centre in list(fps)[:3]:
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3))))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), long_list).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_toxicity_learns_and_ignores_held_out_labels(spark):  # noqa: ANN001
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        words, bad = rnd.choices(vocabulary, k=30), i % 4 == 0
        if bad:
            words[rnd.randrange(30)] = rnd.choice(["vile", "v1le", "scoundrel"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(None, None), (2000, ""), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    got = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), trees=4).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.held_out} == held
    hits = [(r.predicted == dict(labels)[r.doc_id]) for r in got if r.doc_id in held and r.doc_id < 900]
    assert sum(hits) / len(hits) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    lies = [(i, 1 - t if i in held else t) for i, t in labels]
    again = toxicity.scored(docs, spark.createDataFrame(lies, "doc_id long, toxic int"), trees=4).collect()
    same(again, got)
    one_class = toxicity.scored(docs, spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int"))
    assert {r.score for r in one_class.collect()} == {0.0}


def test_neighbours_against_all_distances(spark):  # noqa: ANN001
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((400, 24)).astype(np.float32).round(3)
    vectors[50:60] = vectors[40]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [0.0] * 24), (910, [float("nan")] * 24), (911, [None] * 24), (920, [1.0]), (930, [float("inf")] * 24), (None, rows[3][1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = neighbours.search(frame, F.col("vec_id") % 10 == 0, 10, block=64, queries=8).collect()
    full = vectors.astype(float)
    hits = 0
    for q in range(0, 400, 10):
        away = np.sqrt(((full - full[q]) ** 2).sum(axis=1))
        away[q] = np.inf
        want = [(i, away[i]) for i in np.lexsort((np.arange(400), away))[:10]]
        found = [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert len(found) == 10
        hits += sum(a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 for a, b in zip(found, want))
    assert hits >= 0.98 * len(got) and len(got) == 400
    few = neighbours.search(frame.where("vec_id < 3"), F.col("vec_id") == 0, 10).collect()
    assert [(r.rank, r.query_id) for r in sorted(few, key=lambda r: r.rank)] == [(1, 0), (2, 0)]


def test_token_files_equal_the_library(docs):  # noqa: ANN001
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    start, want = 0, []
    for r in ordered(documents()):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokens.token_files(docs, JSON, 2).collect()
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], want)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == [sum(x.n_tokens for x in by_start[:i]) for i in range(len(by_start))]
    assert [r.doc_id for r in by_start] == [w[0] for w in want]


def test_added_tokens_in_a_text_have_their_own_ids(spark):  # noqa: ANN001
    from tokenizers import Tokenizer

    library, end = Tokenizer.from_file(JSON), "<|endoftext|>"
    texts = [f"one {end} two", end, f"{end}{end} x", f"a{end}b\n", f"é  {end}  é", f"<{end}>", "<|endoftext|", f"x <|endof{end}text|>", "plain", ""]
    got = tokens.token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), JSON, 2).collect()
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same([tuple(r) for r in got], want)


def test_mix_reaches_targets(docs):  # noqa: ANN001
    got = mixing.taken(mixing.mix_documents(docs, block=16)).collect()
    rows = documents()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    same([(r.doc_id, r["size"]) for r in got], [(r[0], size(r[1])) for r in rows])
    by = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in ("a", "b", None)}
    wanted = dict(zip(("a", "b", None), mixing.targets(list(by.values()), [1, 2, 3])))
    assert abs(sum(wanted.values()) - sum(by.values())) < 1e-6
    for s in by:
        of = [r for r in got if r.source == s]
        assert {r.source_size for r in of} == {by[s]} and abs(of[0].target - wanted[s]) < 1e-6
        assert abs(sum(r.taken for r in of) - wanted[s]) <= 1
        assert all(r.taken <= 3 * r["size"] for r in of)
    same(mixing.taken(mixing.mix_documents(docs, block=16)).collect(), got)


def test_targets_share_the_excess():
    assert mixing.targets([10, 100, 1000], [1, 1, 1]) == [30, 300, 780]
    assert mixing.targets([0, 5], [1, 2]) == [0, 5]


def test_schedule_is_even_and_complete(spark):  # noqa: ANN001
    rows = sorted(mixing.schedule(spark, [1000, 3000, 0, 60], block=10).collect(), key=lambda r: r.slot)
    assert Counter(r.src for r in rows) == {0: 100, 1: 300, 3: 6}
    for s in (0, 1, 3):
        assert [r["rank"] for r in rows if r.src == s] == list(range({0: 100, 1: 300, 3: 6}[s]))
    assert 40 <= sum(r.src == 0 for r in rows[:200]) <= 60


def test_mixed_documents_follow_the_schedule(spark):  # noqa: ANN001
    rows = [(i, f"{i} " + "w " * 31, "abc"[i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = [r.source for r in mixing.mixed_documents(docs, block=64).collect()]
    share = {s: order.count(s) / len(order) for s in "abc"}
    assert abs(share["c"] - 0.5) < 0.01
    for i in range(0, len(order) - 90, 90):
        assert all(abs(order[i : i + 90].count(s) / 90 - share[s]) < 0.1 for s in "abc"), i
    got = mixing.taken(mixing.mix_documents(docs, block=64)).collect()
    assert all((r.first_slot is None) == (r.taken == 0) for r in got)


def plain_facts(text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    n = len(words)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_quality_facts(docs):  # noqa: ANN001
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.judged(docs).select(*names, "kept").collect()
    same([tuple(r)[:-1] for r in got], [(r[0], *plain_facts(r[1])) for r in documents()])
    assert not any(r.kept and r.base_failed for r in got) and sum(r.kept for r in got) > 40


def test_model_is_a_distribution_and_bands_reject(spark):  # noqa: ANN001
    rnd = random.Random(4)
    words = ["the", "cat", "sat", "on", "a", "mat", "and", "ran", "home"]
    rows = [(i, " ".join(rnd.choices(words, k=40)), "en") for i in range(200)]
    rows += [(900, " ".join(w + "$%#" for w in rnd.choices(words, k=40)), "en"), (901, "".join(rnd.choices("qxzj ", k=300)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert kept == set(range(200))
    code = np.unique(np.concatenate([quality.grams(r[1]) for r in rows]), return_counts=True)
    levels = quality.model_of(*code)
    codes, logs, _, _ = levels[0]
    assert abs(np.exp(logs).sum() + np.exp(levels[0][3][0]) * (64 - len(codes)) / 64 - 1) < 1e-9
    assert quality.log_perplexity("qqqq zzzz", levels) > quality.log_perplexity("the cat sat", levels) + 1


def test_models_in_several_passes_give_the_same(spark, docs, monkeypatch):  # noqa: ANN001
    want = quality.judged(docs).select("doc_id", "kept", "log_perplexity").collect()
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 1)
    same(quality.judged(docs).select("doc_id", "kept", "log_perplexity").collect(), want)


def test_arc_to_warc(spark):  # noqa: ANN001
    rows = [(i, f"http://x/{i} y", f"<html>{i % 5}\r\n\r\nWARC/1.1\n</html>" * 3) for i in range(30)]
    rows += [(40, None, None), (41, "u\n", ""), (7, "again", rows[7][2]), (None, "n", rows[1][2]), (50, "é", "ü" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.converted(pages).collect()
    payload = [(r[2] or "").encode() for r in rows]
    first: dict[bytes, int] = {}
    for r, p in zip(rows, payload):
        if r[0] is not None:
            first[p] = min(r[0], first.get(p, r[0]))
    digests = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payload]
    same([(r.page_id, r.payload_bytes, r.payload_digest) for r in got], [(r[0], len(p), d) for r, p, d in zip(rows, payload, digests)])
    assert sum(r.record_type == "response" for r in got) == len(set(payload))
    for r in got:
        own = next(p for p, d in zip(payload, digests) if d == r.payload_digest)
        assert r.refers_to == (None if r.record_type == "response" else first[own])
        assert r.record_type == "revisit" or r.page_id == first[own]
    assert {r.record_type for r in warc.converted(pages, least_bytes=10**6).collect()} == {"response"}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions_are_parsed_by_declared_lengths(version):
    body = b"x\n\nhttp://fake 0.0.0.0 20240101000000 text/html 3\nabc"
    archive = warc.member(warc.arc_version_block(version, "n")) + warc.member(warc.arc_record(version, "n", 0, 5, "a b", body)) + b"\0"
    (fields, block), = warc.parse_arc(archive)
    assert warc.split_http(block)[2] == body and fields["URL"] == "a%20b" and fields["Archive-length"] == str(len(block))


def kept_plainly(rows: list[tuple]) -> list[tuple]:
    seen, out = set(), []
    for r in ordered(rows):
        data = (r[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for q in range(len(data) - 99):
            if data[q : q + 100] in seen:
                gone[q : q + 100] = True
            seen.add(data[q : q + 100])
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((r[0], len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("crowd", "batch"), [(64, 1 << 20), (1, 1 << 20), (64, 3000), (2, 500)])
def test_repeats_equal_plain_removal(spark, docs, monkeypatch, crowd, batch):  # noqa: ANN001
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch)
    same(repeats.digests(docs).collect(), kept_plainly(documents()))


@pytest.mark.parametrize("kind", ["document", "line", "letter"])
def test_runs_of_a_frequent_text_are_spread_over_the_shards(spark, monkeypatch, kind):  # noqa: ANN001
    monkeypatch.setattr(repeats, "BATCH_BYTES", 5000)
    rnd = random.Random(9)
    prose = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    page, line = prose(1000), prose(80)
    often = {"document": lambda: page, "line": lambda: prose(90) + line + prose(90), "letter": lambda: "a" * 1000}[kind]
    texts = [often() if i % 3 == 0 else prose(1000 if kind != "line" else 260) for i in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").coalesce(1)
    dealt = repeats.find_runs(docs, 16)
    frames = [dealt, repeats.find_owners(dealt, 16)] if kind != "line" else [dealt]
    for frame in frames:
        sizes = [r.n for r in frame.groupBy("shard").agg(F.sum(F.length("blob")).alias("n")).collect()]
        assert len(sizes) == 16 and max(sizes) < 1.4 * sum(sizes) / 16


def test_suffix_order_is_the_sorted_order():
    rnd = random.Random(6)
    pieces = [bytes(rnd.choices(b"ab", k=rnd.randint(1, 40))) for _ in range(300)]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.cumsum([len(p) for p in pieces])
    group = np.sort(np.array([rnd.randrange(12) for _ in pieces]))
    order = repeats.suffix_order(data, repeats.Hashes(data), end - np.array([len(p) for p in pieces]), end, group)
    assert order.tolist() == sorted(range(300), key=lambda i: (group[i], pieces[i], i))


def test_licence_facts(docs):  # noqa: ANN001
    want = []
    for r in documents():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r[1] or ""))
        at = sorted((i, k) for k, p in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        places = (at[0][0], at[-1][0]) if at else (None, None)
        want.append((r[0], len(words), len(at), *places, ",".join(sorted({k for _, k in at}))))
    got = licences.scan(docs).collect()
    same([tuple(r)[:6] for r in got], want)
    assert {r.labels for r in got if r.n_base} == {"apache", "gpl,mit"}


def test_template_join_equals_all_pairs(spark):  # noqa: ANN001
    rnd, templates = random.Random(8), licences.Templates(containment=0.7)
    rows = []
    for i in range(200):
        sets = [rnd.choice(templates.sets) for _ in range(4)]
        lines = [" ".join(rnd.sample(s, k=min(len(s), rnd.randint(3, 30))) + rnd.choices(["zz", "The", "OF"], k=3)) for s in sets]
        rows.append((i, "\n".join(lines)))
    want = set()
    for i, text in rows:
        for n, line in enumerate(text.split("\n")):
            for label, s, need in zip(templates.labels, templates.sets, templates.needs):
                shared = len(set(line.lower().split()) & set(s))
                if shared >= need:
                    want.add((i, n, label, shared / len(s)))
    prepared = licences.prepared(spark.createDataFrame(rows, "rid long, text string").withColumn("doc_id", F.col("rid")), templates)
    got = licences.template_matches(prepared, templates).collect()
    assert {tuple(r) for r in got} == want and want


WRAPPED = [
    ("mit", "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the"),
    ("gpl", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
            " * the Free Software Foundation, either version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions are met:"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"),
    ("isc", "// Permission to use, copy, modify, and/or distribute this software for any\n// purpose with or without fee is hereby granted, provided"),
    ("mit", "Released under the terms\nof the MIT License"),
]


def test_notices_are_found_over_line_ends_and_scattered_words_are_not(spark):  # noqa: ANN001
    prose = " ".join(["some other words of prose that go on"] * 200)
    rows = [(i, f"{prose}\n{said}\n{prose}") for i, (_, said) in enumerate(WRAPPED)]
    rows += [(10 + i, f"{prose} {said} {prose}".replace("\n", " ")) for i, (_, said) in enumerate(WRAPPED)]
    rows += [(20, f"released {prose} under {prose} the {prose} mit {prose} license"), (21, "\n\n".join(["released", "under", *["x y z"] * 9, "license", "the mit"]))]
    rows += [(22, "under \u00e9\nreleased the, MIT\n\n(license)")]
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(WRAPPED):
        for found, score in (got[i], got[10 + i]):
            assert label in found.split(",") and score >= 0.9, label
    assert [got[i] for i in (20, 21, 22)] == [("", 0.0), ("", 0.0), ("mit", 1.0)]


def test_windows_equal_all_windows(spark):  # noqa: ANN001
    rnd, templates = random.Random(3), licences.Templates(containment=0.7)
    rows = []
    for i in range(60):
        words = []
        for _ in range(3):
            s = rnd.choice(templates.sets)
            words += rnd.sample(s, k=rnd.randint(len(s) // 2, len(s))) + rnd.choices(["zz", "\n", "of", "the"], k=rnd.randint(0, 60))
        rows.append((i, " ".join(words)))
    want = set()
    for i, text in rows:
        words = text.split()
        for label, s, need, n in zip(templates.labels, templates.sets, templates.needs, templates.lengths):
            for at, w in enumerate(words):
                if w in s and (shared := len(set(words[at : at + n]) & set(s))) >= need:
                    want.add((i, at, label, shared / len(s)))
    prepared = licences.prepared(spark.createDataFrame(rows, "rid long, text string").withColumn("doc_id", F.col("rid")), templates)
    got = licences.template_matches(prepared, templates, licences.windows).collect()
    assert {tuple(r) for r in got} == want and want


def test_pipeline_stages(spark, docs):  # noqa: ANN001
    kept, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept.count(), stage(spark, kept, "")
        assert kept.columns == names and 0 < kept.count() <= before, name
    rows = [tuple(r) for r in kept.collect()]
    good = quality.judged(docs).where("kept").count()
    assert len(rows) <= good and all(r[1] is not None for r in rows)
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, "")
    whole = {r[1] for r in rows}
    cut_short = [r for r in mixed.collect() if r.text not in whole]
    assert mixed.columns == names and len(cut_short) <= 3
    ids = corpus_pipeline.STAGES[4][1](spark, mixed, "")
    assert ids.count() == mixed.count() and all(len(r.ids) == r.n_tokens for r in ids.collect())


def test_reading_a_member_does_not_copy_the_archive_behind_it(monkeypatch):  # noqa: ANN001
    copied, opened = [], zlib.decompressobj

    class Reader:
        def __init__(self, bits: int) -> None:
            self.own = opened(bits)

        def decompress(self, data) -> bytes:  # noqa: ANN001
            out = self.own.decompress(data)
            copied.append(len(self.own.unused_data))
            return out

        def __getattr__(self, name: str):  # noqa: ANN204
            return getattr(self.own, name)

    rnd = random.Random(3)
    held = [b"", *[rnd.randbytes(n) for n in (1, 100, warc.READ_BYTES - 1, warc.READ_BYTES, 5 * warc.READ_BYTES)], *[rnd.randbytes(900) for _ in range(200)]]
    archive = b"".join(map(warc.member, held))
    monkeypatch.setattr(warc.zlib, "decompressobj", Reader)
    assert list(warc.members(archive)) == held and list(warc.members(archive + b"\0\0")) == held
    assert max(copied) < warc.READ_BYTES
    assert list(warc.members(archive[:-4]))[:-1] == held[:-1]  # a cut archive ends, too
