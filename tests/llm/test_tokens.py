"""Token counts and packing against plain versions and exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsmood.llm import packing, token_counts
from tests.conftest import rows
from tests.llm.helpers import ODD, docs, random_texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, pieces):
    """Longest match first, building the pieces."""
    out, at = 0, 0
    longest = max(map(len, pieces))
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in pieces:
                out, at = out + 1, end
                break
        else:
            out, at = out + len(word[at].encode()), at + 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.text("abcd", max_size=14))
def test_automaton_equals_greedy_matching(pieces, word):
    assert token_counts.LongestMatch(sorted(pieces)).count(word) == greedy(word, pieces)


def test_counts(spark):
    pieces = set(token_counts.vocabulary(MODEL))
    pairs = list(enumerate(ODD + random_texts(40), 1)) + [(None, "one"), (1, "one")]
    got = token_counts.token_counts(docs(spark, pairs, clashing=True), MODEL).collect()
    want = []
    for i, t in pairs:
        sizes = [greedy("▁" + w, pieces) for w in (t or "").split()]
        want.append((i, len(sizes), sum(sizes), max(sizes, default=0)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(docs(spark, []), MODEL).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_blocks_are_near_equal(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 513, 900).tolist()
    windows = packing.pack_block(sizes, 2048)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(900)) and max(sums) <= 2048
    assert len(windows) <= -(-sum(sizes) // 2048) + 1 and max(sums) - min(sums) < 40


def test_count_rises_when_capacity_is_exceeded():
    assert sorted(map(sorted, packing.pack_block([6, 6, 6], 10))) == [[0], [1], [2]]
    assert packing.pack_block([], 10) == [] and packing.pack_block([10], 10) == [[0]]


ODD_CHUNKS = ["don't 'tis we'll", "<|endoftext|> x<|endoftext|>!!", "İstanbul ǅ ΑΣ, ς", "éa Å ﬁ 한국어", "12ab 3.5", "a.b.c,d"]


@pytest.mark.parametrize("remembered", [300_000, 5])
def test_chunks_have_the_ids_of_the_whole_text(monkeypatch, remembered):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    monkeypatch.setattr(packing, "YOUNG", remembered)
    known = packing._Ids(WORDS)
    for text in [*ODD_CHUNKS, *[t or "" for t in ODD], *random_texts(30)]:
        assert packing._document_ids(known, [text]) == [known.whole(text)]


def test_punctuation_after_every_letter_has_the_ids_of_the_whole_text():
    """Letters that the tokenizer takes apart into a letter and a mark, or that it does not count as letters, among them."""
    known = packing._Ids(WORDS)
    texts = [f"{c}! a{c}. {c}{c}?! .{c} {c}\u0301; x{c}'" for c in map(chr, range(0x30000)) if c.isalpha()]
    rng = random.Random(7)
    mixed = lambda: rng.choice([chr(rng.randint(1, 0x2FF)), chr(rng.randint(0x300, 0x36F)), chr(rng.randint(0x370, 0x1FFF)), rng.choice("ab .,!?'-\n")])
    texts += ["".join(mixed() for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    texts += ["".join(chr(rng.randint(1, 255)) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    for at in range(0, len(texts), 5000):
        some = texts[at: at + 5000]
        want = [np.array(e.ids, "<u4").tobytes() for e in known.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        assert packing._document_ids(known, some) == want


def test_packing_round_trip(spark):
    texts = ODD + ODD_CHUNKS + random_texts(300, length=(0, 700))
    pairs = list(enumerate(texts, 1)) + [(None, "no id"), (4, "one")]
    got = packing.pack(docs(spark, pairs, clashing=True), WORDS, with_ids=True, windows=16).collect()
    known = packing._Ids(WORDS)
    by_row, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by_row[r["row"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    found = []
    for parts in by_row.values():
        parts.sort(key=lambda r: r["start"])
        ids = [i for r in parts for i in r["ids"]]
        assert [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts])[:-1].tolist() and parts[0]["doc_tokens"] == len(ids)
        found.append((parts[0]["doc_id"], ids))
    want = [(i, np.frombuffer(known.whole(t or ""), "<u4").tolist() + [1]) for i, t in pairs]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts])[:-1].tolist()
        assert sum(r["length"] for r in parts) <= 2048
    assert sum(r["length"] for r in got) / (2048 * len(sequences)) > 0.95


def test_empty(spark):
    assert rows(packing.pack(docs(spark, []), WORDS)) == []
