"""SimHash components, groups of similar texts and long repeated strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from newsmood.llm import chunks, simhash_pivots, suffix_levels
from newsmood.llm.components import components
from tests.llm.helpers import ODD, docs, random_texts

SPACE = bytes([0x20, *range(9, 14)])


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in "".join(" " if ord(c) < 128 and ord(c) in SPACE else c for c in low).split(" ") if w]


def plain_fingerprint(text, n=3):
    w = words(text)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i: i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    """Smallest reachable node of every node, by depth-first search."""
    beside = defaultdict(set)
    for a, b in linked:
        beside[a].add(b)
        beside[b].add(a)
    out = {}
    for start in sorted(nodes):
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in out:
                out[x] = start
                stack += beside[x]
    return out


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "zz" + str(rng.random())[2:6]
    return " ".join(w)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 700), (1, 0)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    nodes = {x for link in links if link[0] != link[1] for x in link}
    want = roots(nodes, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("n", [10, 1 << 26, 1 << 33])
def test_linked_fingerprints_share_a_key(n):
    """Any three changed bits leave one choice of families with the same coordinates, for every number of blocks."""
    b = simhash_pivots.blocks_for(n)
    masks = np.array(simhash_pivots.block_masks(b), np.uint64)
    families, _ = simhash_pivots.pivots(b)
    assert np.bitwise_or.reduce(masks) == np.uint64(2**64 - 1) and sum(int(m).bit_count() for m in masks) == 64
    rng = random.Random(n)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 3):
            y ^= 1 << bit
        cx, cy = simhash_pivots.coordinates(np.array([x, y], np.uint64), families, masks)
        assert (cx == cy).sum() >= b - 3


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = random_texts(120, seed=5, vocabulary=3000, length=(3, 200))
    near = [edited(t, rng, k) for t in base[:40] if t for k in (1, 1, 2)]
    hot = [base[7]] * 150 + [edited(base[7], rng, 1) for _ in range(60)]
    pairs = list(enumerate(ODD + base + near + hot, 1)) + [(None, base[7]), (None, "alone and without an id"), (2, base[9])]
    got = simhash_pivots.near_duplicates(docs(spark, pairs, clashing=True)).collect()
    prints = {t: plain_fingerprint(t) for _, t in pairs}
    assert Counter(r["fingerprint"] for r in got) == Counter(f"{prints[t]:016x}" for _, t in pairs)
    distinct = sorted(set(prints.values()))
    linked = [(x, y) for i, x in enumerate(distinct) for y in distinct[:i] if (x ^ y).bit_count() <= 3]
    root = roots(distinct, linked)
    least = {}
    for i, t in pairs:
        if i is not None:
            k = root[prints[t]]
            least[k] = min(i, least.get(k, i))
    want = Counter((i, least.get(root[prints[t]])) for i, t in pairs)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == want
    assert simhash_pivots.near_duplicates(docs(spark, [])).count() == 0


def plain_groups(pairs, n=5, least=0.8):
    sets = {}
    for i, t in pairs:
        w = words(t)
        sets[i] = {tuple(w[k: k + n]) for k in range(max(1, len(w) - n + 1))} if w else {()}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return roots(set(sets), linked)


def test_similar_groups(spark):
    rng = random.Random(9)
    base = random_texts(60, seed=6, vocabulary=3000, length=(30, 160))
    near = [edited(t, rng, k) for t in base[:30] for k in (1, 2, 4, 8)]
    hot = [edited(base[40], rng, 1) for _ in range(120)] + [base[41].upper(), base[41].replace(" ", "\n")]
    pairs = list(enumerate(ODD + base + near + hot, 1))
    got = simhash_pivots.similar_groups(docs(spark, [*pairs, (None, base[3])], clashing=True)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_groups(pairs)
    kept = simhash_pivots.keep_rows(docs(spark, [*pairs, (None, base[3])], clashing=True))
    assert {r["doc_id"] for r in kept.collect()} == {None} | {i for i, root in plain_groups(pairs).items() if i == root}
    assert kept.columns[-1] == "score" and simhash_pivots.keep_rows(docs(spark, [])).count() == 0


def test_fingerprints_by_pivots_settle_groups(spark, monkeypatch):
    """Similar texts within the fingerprints' radius are grouped by the tables of pivots alone; the cells of minima get only what those leave."""
    rng = random.Random(29)
    base = random_texts(12, seed=33, vocabulary=3000, length=(500, 900))
    pairs = list(enumerate(base + [edited(t, rng, 1) for t in base for _ in range(3)], 1))
    prints = {i: int(f) for i, f in simhash_pivots.sketches(docs(spark, pairs), "doc_id", "text", 5).select("doc_id", "fp").collect()}
    near = {(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 3}
    texts = dict(pairs)
    assert near and all(plain_groups([(a, texts[a]), (b, texts[b])])[b] == a for a, b in near)
    linked, per_cell, asked = roots(set(texts), near), simhash_pivots._per_cell, []

    def recorded(met, search):
        found = per_cell(met, search)
        asked.extend((r["a"], r["b"]) for r in found.collect())
        return found

    monkeypatch.setattr(simhash_pivots, "_per_cell", recorded)
    got = simhash_pivots.similar_groups(docs(spark, pairs)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_groups(pairs)
    assert len(set(linked.values())) < len(linked) and all(linked[a] != linked[b] for a, b in asked)


def test_groups_with_pairs_on_both_sides_of_the_limit(spark):
    """A member whose best estimate fails on the whole texts still finds its other partners."""
    rng = random.Random(13)
    pairs = []
    for base in random_texts(12, seed=21, vocabulary=3000, length=(60, 140)):
        n = len(base.split())
        pairs += [edited(base, rng, k) for k in rng.choices(range(1, max(2, n // 40) + 2), k=25)]
    pairs = list(enumerate(pairs, 1))
    got = simhash_pivots.similar_groups(docs(spark, pairs)).collect()
    want = plain_groups(pairs)
    assert 20 < len(set(want.values())) < 280
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_work_on_a_large_group_grows_with_its_size(spark, monkeypatch):
    """Of a group of near copies on both sides of the limit few pairs become rows; its parts are compared in blocks that lose no link."""
    rng = random.Random(41)
    (base,) = random_texts(1, seed=45, vocabulary=3000, length=(200, 200))
    pairs = list(enumerate([edited(base, rng, rng.randint(1, 5)) for _ in range(160)] + ["", "some other words", None], 1))
    asked, tested = [], simhash_pivots._tested

    def recorded(ties, *more):
        asked.append(ties.count())
        return tested(ties, *more)

    monkeypatch.setattr(simhash_pivots, "_tested", recorded)
    got = simhash_pivots.similar_groups(docs(spark, pairs)).collect()
    want = plain_groups(pairs)
    assert 10 < len(set(want.values())) < 150
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert sum(asked) < 8 * len(pairs)

    monkeypatch.setattr(simhash_pivots, "PART_ROWS", 40)
    got = simhash_pivots.similar_groups(docs(spark, pairs)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("across", [False, True])
def test_links_of_a_block(across):
    """A block of one part, and of two parts whose members are compared with the other part only."""
    rng = random.Random(17)
    base = [rng.getrandbits(64) for _ in range(150)]
    sets = [np.unique(np.array(rng.sample(base, rng.randint(110, 150)) + [rng.getrandbits(64)], np.uint64)) for _ in range(60)] + [np.zeros(0, np.uint64)] * 2
    groups, side = np.array([5 * i // 2 for i in range(62)]), np.array([i % 2 if across else 0 for i in range(62)])
    linked = [(int(groups[i]), int(groups[k])) for i in range(62) for k in range(i)
              if (side[i] != side[k] or not across) and simhash_pivots.jaccard(sets[i], sets[k]) >= 0.8]
    got = simhash_pivots._block_links(sets, groups, side, 0.8)
    nodes = set(groups.tolist())
    assert roots(nodes, got) == roots(nodes, linked) and 1 < len(set(roots(nodes, linked).values())) < len(nodes)
    assert len(got) < len(nodes)


def test_levels_grow_geometrically():
    rng = np.random.default_rng(1)
    family, want = chunks.Levels(), Counter()
    for _ in range(64):
        keys = np.unique(rng.integers(0, 1 << 20, 9000).astype(np.uint64))
        family.add(keys, np.ones(len(keys), np.int64))
        want.update(keys.tolist())
        assert len(family.levels) <= 8
    ask = np.arange(0, 1 << 20, 7, dtype=np.uint64)
    assert family.totals(ask).tolist() == [want[int(k)] for k in ask]


def plain_removal(pairs, length):
    raw = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter(b[k: k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k: k + length]] > 1:
                gone[k: k + length] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("chunk", [12_000_000, 20_000])
def test_repeated_strings(spark, monkeypatch, chunk):
    """In one chunk, and over many chunks."""
    monkeypatch.setattr(suffix_levels, "CHUNK_BYTES", chunk)
    rng = random.Random(3)
    base = random_texts(60, seed=8, length=(0, 150))
    passage = " ".join(random_texts(1, seed=10, length=(60, 60)))
    inside = [t[: len(t) // 2] + passage + t[len(t) // 2:] for t in base[:20]]
    near = [edited(t, rng, 1) for t in base[20:40] if len(t.split()) > 60]
    pairs = list(enumerate([*ODD, *base, *inside, *near, base[45], base[45], "ab" * 900, "Shti " * 400, passage[:199], passage[3:203]], 1)) + [(None, base[50]), (3, base[51])]
    got = suffix_levels.repeated(docs(spark, pairs, clashing=True)).collect()
    key = lambda r: repr((r[0], r[1], r[4]))
    assert sorted(((*tuple(r)[:5], bytes(r["kept"])) for r in got), key=key) == sorted(plain_removal(pairs, 200), key=key)


def test_texts_longer_than_a_span(spark, monkeypatch):
    monkeypatch.setattr(suffix_levels, "SPAN", 3000)
    long = " ".join(random_texts(40, seed=12, length=(40, 80)))
    pairs = [(1, long), (2, long[1000:9000]), (3, "q" * 250 + long[5000:5400])]
    got = suffix_levels.repeated(docs(spark, pairs)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(x[:5] for x in plain_removal(pairs, 200))


def test_no_documents(spark):
    assert suffix_levels.repeated(docs(spark, [])).count() == 0
