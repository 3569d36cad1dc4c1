"""Alignment of two tokenizers against plain loops over tokens and pairs."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from newsmood.llm import token_alignment as ta
from tests.llm.helpers import ODD, docs, random_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    a_of = {i: t for t, i in json.load(open(A))["model"]["vocab"].items()}
    from tokenizers.pre_tokenizers import ByteLevel

    letters = {}
    for code in [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x800)]:
        raw = chr(code).encode()
        for byte, letter in zip(raw, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]):
            letters[letter] = byte
    a_bytes = lambda i: bytes(letters[c] for c in a_of[i])
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(of(i)), i))
            at += len(of(i))
        return out

    def align(texts):
        tokens, pairs = [], []
        for text in texts:
            whole = (" " + (text or "")).encode()
            x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
            same = text and b"".join(map(a_bytes, x)) == whole and b"".join(map(b_bytes, y)) == whole
            tokens.append((spans(x, a_bytes), spans(y, b_bytes)) if same else ([], []))
            found, j = Counter(), 0
            xs, ys = tokens[-1]
            for s, e, i in xs:
                while j < len(ys) and ys[j][1] <= s:
                    j += 1
                for s2, _, k in ys[j:]:
                    if s2 >= e:
                        break
                    found[i, k] += 1
            pairs.append(found)
        documents = Counter(p for found in pairs for p in found)
        best = {}
        for (i, _), n in documents.items():
            best[i] = max(best.get(i, 0), n)
        out = []
        for (xs, ys), found in zip(tokens, pairs):
            both = sorted({e for _, e, _ in xs} & {e for _, e, _ in ys})
            groups, start = [], 0
            for end in both:
                groups.append(",".join(str(i) for s, e, i in xs if start <= s < end) + "|" + ",".join(str(i) for s, e, i in ys if start <= s < end))
                start = end
            out.append((len(xs), len(ys), len(groups), sum(found.values()), sum(n for p, n in found.items() if documents[p] == best[p[0]]),
                        sum(n * documents[p] for p, n in found.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if xs else ""))
        return out

    return align


SPECIAL = ["<|endoftext|> <s> </s> <unk> <0x41>", "with ▁ inside", "a  b\n\n\tc  ", " leading", " x　y", "don't 12345 ½ ﬁ Ａ é", "\x00", "日本語テキスト。 שלום नमस्ते", "👩‍👩‍👧‍👦", "a" * 700]
SHORT = [t if t is None or len(t) < 9000 else t[:3000] for t in ODD]


@pytest.mark.parametrize("sizes", [{}, {"run_records": 60, "parts": 3, "fan_in": 2}])
def test_against_plain_loops(spark, plain, sizes):
    """Also with runs so short that counts are merged over several levels."""
    texts = SHORT + SPECIAL + random_texts(60, seed=13) + ["the same text again."] * 15
    got = ta.alignments(docs(spark, texts, clashing=True), A, B, **sizes).collect()
    assert {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in got} == dict(enumerate(plain(texts), 1)) and len(got) == len(texts)


def test_null_and_repeated_ids(spark, plain):
    texts = ["one text", "one text", None, "two texts"]
    got = ta.alignments(docs(spark, [(None, texts[0]), (1, texts[1]), (1, texts[2]), (1, texts[3])]), A, B).collect()
    want = plain(texts)
    assert sorted((tuple(r[f] for f in ("doc_id", *FIELDS)) for r in got), key=repr) == sorted(((None if k == 0 else 1, *w) for k, w in enumerate(want)), key=repr)
    assert ta.alignments(docs(spark, []), A, B).count() == 0
    assert [r["count_sum"] for r in ta.alignments(docs(spark, [None, ""]), A, B).collect()] == [0, 0]


def test_encoders_agree_on_random_characters():
    pair, other = ta.Pair(A, B), Tokenizer.from_file(A)
    other.encode_special_tokens = True
    rng = random.Random(5)
    draw = lambda: chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF), 32, 10, 39, 115]))
    texts = ["".join(draw() for _ in range(30)) for _ in range(5000)]
    assert [pair.a.encode_ordinary(t) for t in texts] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def test_counted_runs_merge_in_order():
    import numpy as np

    runs = [{5: 1, 9: 2, 40: 1}, {5: 3}, {}, {9: 1, 41: 7}]
    packed = [ta._packed(ta._steps(np.array(sorted(r), np.uint32)), np.array([r[k] for k in sorted(r)], np.uint64)) for r in runs]
    pairs, counts = ta.merge_counts(packed, 10)
    assert pairs.tolist() == [5, 9, 40, 41] and counts.tolist() == [4, 3, 1, 7]
    assert ta._best(pairs, counts, 10).tolist() == [True, False, False, True]
