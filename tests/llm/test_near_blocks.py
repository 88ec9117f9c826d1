"""Blocks of large buckets: no similar pair is lost, each is told once, and a passage's bucket does not emit its square."""

import random

import numpy as np
import pytest

from chunkwell.llm import components as parts
from chunkwell.llm import near_dedup

VOCAB = [f"w{i}" for i in range(4000)]


def members(seed, groups=60, extra=60, passage=40):
    """Words of texts that share a passage; those of one group are edited copies of various shares."""
    r, texts = random.Random(seed), []
    shared = [r.choice(VOCAB) for _ in range(passage)]
    for _ in range(groups):
        base = shared + [r.choice(VOCAB) for _ in range(r.choice((extra, 4 * extra, 16 * extra)))]
        for share in (0, 0.08, 0.16, 0.19):
            text = list(base)
            for at in r.sample(range(len(text)), int(share * len(text))):
                text[at] = r.choice(VOCAB)
            texts.append(text[: len(text) - r.randint(0, 3)])
    words = [near_dedup.word_hashes(" ".join(t).encode()) >> np.uint64(32) for t in texts]
    return np.arange(len(words)), np.array([len(w) for w in words]), words


def truly(words, roots):
    return {(i, j) for j in range(len(words)) for i in range(j) if roots[i] != roots[j] and near_dedup.similar(words[i], words[j])}


@pytest.mark.parametrize("slices", [1, 3])
def test_blocks_lose_no_similar_pair(slices):
    ids, n, words = members(5)
    roots, sides, bits = ids // 2 * 2, ids % slices, [near_dedup.bitmap(w) for w in words]
    told = []
    for i in range(slices):
        for j in range(i, slices):
            at = np.flatnonzero((sides == i) | (sides == j))
            one, two, above = near_dedup.block_pairs(ids[at], roots[at], n[at], [bits[x] for x in at], None if i == j else sides[at], 0.8)
            told += zip(one.tolist(), two.tolist(), strict=True)
            pairs = near_dedup.margin(n[one], [bits[x] for x in one], n[two], [bits[x] for x in two], 0.8)
            assert (above >= 0).all() and (pairs >= above).all()
    wanted = truly(words, roots)
    assert len(wanted) > 100 and wanted <= set(told) and len(told) == len(set(told))


def test_a_passage_does_not_emit_its_square():
    ids, n, words = members(6, groups=300, passage=30, extra=90)
    first = ids % 4 == 0  # no two of these are copies
    found = near_dedup.block_pairs(ids[first], ids[first], n[first], [near_dedup.bitmap(words[i]) for i in ids[first]], None, 0.8)
    assert len(found[0]) <= 0.01 * first.sum() ** 2 / 2


def test_a_pair_is_told_by_its_first_common_band_only():
    ids, n, words = members(7, groups=20)
    roots, bits, keys = ids, [near_dedup.bitmap(w) for w in words], np.array([near_dedup.bands(w) for w in words])
    told = []
    for key in np.unique(keys):
        at = np.flatnonzero((keys == key).any(axis=1))
        if len(at) > 1:
            one, two, _ = near_dedup.block_pairs(ids[at], roots[at], n[at], [bits[x] for x in at], None, 0.8, keys[at], int(key))
            told += zip(one.tolist(), two.tolist(), strict=True)
    wanted = {(i, j) for i, j in truly(words, roots) if (keys[i] == keys[j]).any()}
    assert wanted <= set(told) and len(told) == len(set(told))


def test_components_in_rounds(spark, monkeypatch):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)]
    table = spark.createDataFrame(edges, "a long, b long")
    whole = {x.v: x.root for x in parts.components(table).collect()}
    monkeypatch.setattr(parts, "IN_ONE_TASK", 20)
    assert {x.v: x.root for x in parts.components(table).collect()} == whole and whole[1040] == 1000
