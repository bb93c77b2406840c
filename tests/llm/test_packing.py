import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from marlstone.llm import packing


def test_pieces_and_slots(odd):
    reference = Tokenizer.from_file(packing.default_tokenizer())
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect())
    rows = packing.pack(odd).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    want = Counter()
    for (i, t), n in texts.items():
        ids = [*reference.encode(t, add_special_tokens=False).ids, 2]
        for k, (s, m) in enumerate(packing.cut(len(ids), 1024)):
            want[(i, k, s, m, zlib.crc32(np.array(ids[s : s + m], "<u4").tobytes()))] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.sequences(packing.pack(odd)).agg({"tokens": "sum"}).first()[0] == sum(r["length"] for r in rows)


@pytest.mark.parametrize("text", ["", " ", "a b", "a  b", "a   b ", " a", "a\n b", "a \n", "\n\n x", "it's  we'll", "a  b", "x\x1c y", "a<|endoftext|> b", "é \U0001f600 ñ", "1 2  3\t4", "  lead", "trail  "])
def test_ids_equal_the_tokenizers(text):
    reference = Tokenizer.from_file(packing.default_tokenizer())
    assert np.frombuffer(packing.Encoder(packing.default_tokenizer()).ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" + " " * 1_000_000 + "b", "\n\t" * 600_000, " " * 99_999 + "x", "x" * 300_000, "\u3000" * 400_000], ids=["spaces", "lines", "short", "word", "wide"])
def test_very_long_runs(text):
    reference = Tokenizer.from_file(packing.default_tokenizer())
    assert np.frombuffer(packing.Encoder(packing.default_tokenizer()).ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_random_white_space():
    reference, own, r = Tokenizer.from_file(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer()), random.Random(1)
    for _ in range(400):
        text = "".join(r.choice([" ", " ", "\n", "\t", "a", "b'", "s", "1", "é", ".", " ", "\r", "the "]) for _ in range(r.randrange(30)))
        assert np.frombuffer(own.ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_valid_and_tight(seed):
    r = random.Random(seed)
    histogram = {r.randrange(1, 1025): r.randrange(1, 5000) for _ in range(r.choice([1, 3, 200]))}
    loads, taken = Counter(), Counter()
    spans = {}
    for length, first, last, per, sequence, place in packing.plan(histogram):
        for i in range(last - first):
            s, at = sequence + i // per, place + i % per * length
            loads[s] += length
            spans.setdefault(s, []).append((at, length))
        taken[length] += last - first
    assert taken == Counter(histogram) and max(loads.values()) <= 1024
    for places in spans.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    # No worse than first-fit decreasing over the items themselves.
    bins = []
    if sum(histogram.values()) < 20_000:
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                i = next((i for i, b in enumerate(bins) if b + length <= 1024), None)
                if i is None:
                    bins.append(length)
                else:
                    bins[i] += length
        assert len(loads) <= 1.02 * len(bins) + 1


def test_cut_and_empty(nothing):
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.pack(nothing).count() == 0


def test_other_cutting_rules_go_through_the_files_own_library(tmp_path):
    import json

    import public_tokenizers

    from marlstone.llm import packing as p

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)
    assert p.is_plain(vocabulary) and p.Encoder(public_tokenizers.path("byte_bpe_50k.json")).fast
    for change in ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"normalizer": {"type": "NFC"}}, {"model": vocabulary["model"] | {"ignore_merges": True}}):
        (tmp_path / "t.json").write_text(json.dumps(vocabulary | change))
        e = p.Encoder(str(tmp_path / "t.json"))
        assert not e.fast and e.ids("Hello there") == np.array(e.tokenizer.encode("Hello there", add_special_tokens=False).ids, "<u4").tobytes()
