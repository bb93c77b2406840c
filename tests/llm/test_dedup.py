import hashlib
import re

import numpy as np
import pytest

from marlstone.llm import dedup


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check(rows, texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(normal(t), []).append(i)
    want = sorted((i if i is not None else -1, min((x for x in groups[normal(t)] if x is not None), default=None), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in texts)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows)
    assert got == want
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("history_to", [None, -1, 3, 100])
def test_groups_as_brute_force_has_them(odd, history_to):
    texts = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    rows = dedup.exact_dedup(odd, history_to).collect()
    check(rows, texts)
    if history_to == 100:
        assert all(r["known"] for r in rows if r["doc_id"] is not None)
    if history_to == -1:
        assert not any(r["known"] for r in rows)


def test_keep_first(odd):
    texts = [normal(r["text"]) for r in odd.select("text").collect()]
    kept = dedup.keep_first(odd)
    assert kept.columns == odd.columns and sorted(normal(r["text"]) for r in kept.collect()) == sorted(set(texts))


def test_empty(nothing):
    assert dedup.exact_dedup(nothing).count() == 0 and dedup.keep_first(nothing).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_hash_is_perfect_and_minimal(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(0, 2**64, (2, max(n, 1), 4), dtype=np.uint64)
    keys = keys[:n]
    sizes, bitmap, slot = dedup.build_hash(keys)
    assert sorted(slot) == list(range(n)) and (dedup.find_slots(keys, sizes, bitmap) == slot).all()
    found = dedup.find_slots(others, sizes, bitmap)
    hits = found >= 0
    assert not hits.any() or not (keys[np.argsort(slot)][found[hits]] == others[hits]).all(axis=1).any()


def test_repeated_digests_are_refused():
    with pytest.raises(ValueError, match="repeat"):
        dedup.build_hash(np.zeros((2, 4), np.uint64))
