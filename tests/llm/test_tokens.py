from __future__ import annotations

import base64
import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from parchmint.llm import splitting
from parchmint.llm.arrowtext import Texts
from parchmint.llm.byte_bpe import Utf8Machine, model, round_trip
from parchmint.llm.packing import POOL_BYTES, TIERS, Packer, pack_documents
from parchmint.llm.word_tokens import ChunkIds, PrefixCounter, WordEnd, token_counts, tokenizer
from tests.llm.conftest import documents

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["it's DON'T you'll <|endoftext|>x y<|startoftext|> 'RE 12345 áb é İstanbul ſ K ß ΑΣ 中文字 ,,,!!! a\x0bb a\xa0b", "", " ", "<|endoftext|>", "x" * 300, "''''s 's't", "aͅ é́ 가 😀😀", "aaaaabbbb" * 30, "\x00\x01  \t\t\n a"]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [*ODD, *(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect())]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(texts, library):
    bpe = model(RANKS, public_tokenizers.PATTERN)
    for t in texts:
        ids = bpe.encode(t)
        assert ids == library.encode_ordinary(t)
        assert bpe.decode_bytes(ids) == t.encode() and "".join(bpe.stream(ids, 3)) == t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_byte_bpe_of_any_text(text):
    import tiktoken  # noqa: F401

    bpe = model(RANKS, public_tokenizers.PATTERN)
    assert "".join(bpe.stream(bpe.encode(text), 1)) == text


def test_byte_bpe_merges_random_bytes(library):
    rng, bpe = random.Random(5), model(RANKS, public_tokenizers.PATTERN)
    for _ in range(300):
        word = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 40)))
        want = library.encode_ordinary(word)
        assert list(bpe.encode_piece(word.encode())) == want
        assert len(bpe.encode_piece(word.encode())) == 1 or [i for part in bpe.tokens(word.encode(), 3) for i in part] == want


def test_a_long_piece_is_emitted_as_its_tokens_become_certain(library):
    rng, bpe = random.Random(15), model(RANKS, public_tokenizers.PATTERN)
    word = "".join(rng.choice("aeinrsté") for _ in range(70_000))
    parts = list(bpe.tokens(word.encode()))
    assert len(parts) > 15 and [i for part in parts for i in part] == library.encode_ordinary(word) == bpe.encode(word)


@given(st.binary(max_size=30), st.lists(st.integers(1, 5), max_size=12))
def test_utf8_machine_equals_the_decoder_on_text(data, cuts):
    text = data.decode("utf-8", "ignore").encode()
    machine, at, out = Utf8Machine(), 0, ""
    for c in [*cuts, len(text)]:
        out += machine.feed(text[at : at + c])
        at += c
    assert out + machine.finish() == text.decode()


def test_round_trip_rows(spark, awkward, empty, library):
    rows = round_trip(awkward, RANKS, public_tokenizers.PATTERN).collect()
    want = {}
    for r in awkward.collect():
        t = r.text or ""
        ids = library.encode_ordinary(t)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert len(rows) == awkward.count() and {r.id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
    assert round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_prefix_counts_equal_the_library(texts):
    counter, lib = PrefixCounter(WORDS), tokenizer(WORDS)
    assert counter.totals(pa.array(texts)).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    for t in [ODD[0], "it's DON'T you'll we're 's 'l Ærø à 12 ½", texts[-1][:200]]:
        table = counter.table(t)
        exact = [len(lib.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert [counter.count(t, k, table) for k in range(len(t) + 1)] == exact
        for budget in (0, 1, 7, 50, 10_000):
            best = counter.longest_prefix(t, budget)
            assert exact[best] <= budget and (best == len(t) or counter.table(t)[1][-1] > budget)
            assert best == len(t) or exact[best + 1] > budget


def test_longest_prefixes_of_all_scripts_equal_brute_force():
    counter, lib, rng = PrefixCounter(WORDS), tokenizer(WORDS), random.Random(31)
    parts = ["a", "é", "é", "中", "文", "가", "각", "ſ", "İ", "Σ", "'s", "'re", "'", " ", "\n", "\t", "!", "1", "½", "٣", "<|endoftext|>", "<|endo", "̣", "Å", "ﬁ", "😀", "th", "ing", "\u3000"]

    def tokens(text):
        return len(lib.encode(text, add_special_tokens=False).ids)

    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        cuts = counter.table(text)[3].tolist()
        exact = [tokens(text[:k]) for k in range(len(text) + 1)]
        assert [counter.count(text, k) for k in range(len(text) + 1)] == exact and {0, len(text)} <= set(cuts)
        for budget in range(7):
            assert counter.longest_prefix(text, budget) == (len(text) if exact[-1] <= budget else max(k for k in cuts if exact[k] <= budget))


def test_long_texts_without_spaces_are_cut_in_linear_time():
    counter, lib, rng = PrefixCounter(WORDS), tokenizer(WORDS), random.Random(32)
    counter.longest_prefix("中 x", 1)
    for text in ("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(100_000)), "a" * 200_000, "".join(rng.choice("aeiou") + rng.choice("\u0323\u0300") for _ in range(30_000))):
        begun = time.perf_counter()
        best = counter.longest_prefix(text, 2048)
        assert time.perf_counter() - begun < 5  # hours where every prefix is encoded
        exact = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(best, best + 6)]
        assert exact[0] <= 2048 and all(n > 2048 for k, n in zip(range(best, best + 6), exact, strict=True) if k > best and k in counter.table(text)[3])


def test_long_words_are_counted_as_far_as_asked():
    model = WordEnd(WORDS)
    rng = random.Random(33)
    for word in ("a" * 1000, "".join(rng.choice("aeinrst") for _ in range(1500))):
        whole = list(model.tables([word.encode()])[0])
        for budget in (0, 1, 20, 100):
            some = model.counts_within(word.encode(), budget)
            assert some == whole[: len(some)] and all(n > budget for n in whole[len(some) :])


def test_the_pool_of_a_partition_holds_tails_and_not_documents():
    packer, largest = Packer(0), 0
    for i in range(3000):
        packer.add(i, bytes(4 * 4097))
        held = sum(len(ids) for _, ids, _, _ in packer.held.values())
        largest = max(largest, packer.waiting())
        assert held == 4 * packer.tokens and len(packer.held) == len(packer.pool)
    assert largest <= 2 * POOL_BYTES + 4 * 4097 + 256
    for i in range(40_000):
        packer.add(3000 + i, bytes(4))
        largest = max(largest, packer.waiting())
    packer.finish()
    assert largest <= 2 * POOL_BYTES + 4 * 4097 + 256 and not packer.held
    pieces = Counter()
    for doc, start, length, *_ in packer.ready:
        pieces[doc] += length
    assert pieces == {**{i: 4097 for i in range(3000)}, **{3000 + i: 1 for i in range(40_000)}}


def test_splits_equal_the_patterns():
    """Both vectorised splits against their patterns, on every code point below U+3000 and on odd sequences."""
    rng = random.Random(11)
    alphabet = ["'", "'s", "'re", "'l", "'ll", " ", "  ", "\n", "\t ", "\xa0", "a", "Zé", "1", "½", "٣", ".", "!?", "中", "\x1c", "\x85", "s", "e"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += ["a" + chr(c) + "b" + chr(c) + " 1" for c in range(0x3000)]
    column = pa.array(["left out", *texts])[1:]
    word_pattern = WordEnd(WORDS).split
    for split, pattern in ((splitting.byte_pieces, regex.compile(public_tokenizers.PATTERN)), (splitting.words, word_pattern)):
        found = split(Texts(column))
        got = [[found.distinct[i].decode() for i in found.index[a:b]] for a, b in zip(found.at, found.at[1:], strict=False)]
        assert got == [pattern.findall(t) for t in texts]


def test_plain_rows_are_encoded_as_the_library_does():
    lib, encoder = tokenizer(WORDS), ChunkIds(WORDS)
    texts = ["x" + chr(c) + "Y " + chr(c) + chr(c) + "1" for c in range(0x200)] + ["a <|endoftext|>", "|endoftext|>", None, "", "İ A"]
    got = encoder.encode_many(pa.array(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_recent_results_stay_and_are_bounded():
    made, recent = [], splitting.Recent(100)
    for i in range(400):
        keys = ["always", *range(10 * i, 10 * i + 10)]
        assert recent.fetch(keys, lambda new: made.extend(new) or [str(k) for k in new]) == [str(k) for k in keys]
        assert len(recent) <= 130
    assert made.count("always") == 1 and len(made) == 4001


def test_word_tables_count_every_prefix():
    words, lib = WordEnd(WORDS), tokenizer(WORDS)
    for word in ("thingstionandly", "a", "zzzzqx", "internationalisation"):
        assert words.counts(word.encode()) == [len(lib.encode(word[:k], add_special_tokens=False).ids) for k in range(len(word) + 1)]


def test_token_count_rows(awkward, empty):
    lib = tokenizer(WORDS)
    rows = token_counts(awkward, WORDS).collect()
    assert len(rows) == awkward.count()
    want = {r.doc_id: (len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.collect()}
    assert {r.id: (r.n_bytes, r.n_tokens) for r in rows} == want
    for r in awkward.collect():
        fits = next(x.limit_chars for x in rows if x.id == r.doc_id and (x.n_bytes == len((r.text or "").encode())))
        assert len(lib.encode((r.text or "")[:fits], add_special_tokens=False).ids) <= 2048 and (want[r.doc_id][1] > 2048) == (fits < len(r.text or ""))
    assert token_counts(empty, WORDS).count() == 0


def check_packed(rows, table):
    lib = tokenizer(WORDS)
    ids = {}
    for r in table:
        ids.setdefault(r.doc_id, []).append([*lib.encode(r.text or "", add_special_tokens=False).ids, 2])
    windows, tokens = {}, 0
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
        tokens += r.length
        assert any(zlib.crc32(np.array(d[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(d) == r.doc_tokens for d in ids[r.id])
    assert tokens == sum(len(d) for some in ids.values() for d in some)
    for some in windows.values():
        end = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == end and r.length > 0
            end += r.length
        assert end <= 4096 and end & (end - 1) == 0 and {r.tier for r in some} == {end}
    groups = {}
    for some in windows.values():
        groups.setdefault(some[0].step_group, []).append(sum(r.length for r in some))
    assert max(map(sum, groups.values())) <= 8 * 4096
    return windows


def test_packing_covers_every_id_once_without_padding(spark, sf, awkward, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    windows = check_packed(pack_documents(docs, WORDS).collect(), docs.collect())
    full = [s for s in windows.values() if sum(r.length for r in s) in TIERS]
    assert len(full) > 0.6 * len(windows)
    once = awkward.dropDuplicates(["doc_id"])
    check_packed(pack_documents(once, WORDS).collect(), once.collect())
    assert pack_documents(empty, WORDS).count() == 0


def test_pieces_of_a_document_join_without_gaps(spark):
    docs = documents(spark, ["word " * n for n in (1, 5000, 12000, 300, 4095, 4096)])
    by = {}
    for r in pack_documents(docs, WORDS).collect():
        by.setdefault(r.id, []).append((r.start, r.length, r.doc_tokens))
    for some in by.values():
        end = 0
        for start, length, total in sorted(some):
            assert start == end
            end += length
        assert end == total
