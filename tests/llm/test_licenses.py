import random
import re

from marlstone.llm import licenses

from .conftest import frame

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def slow_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return words, places


def test_base(spark, odd_texts):
    texts = [*odd_texts, "Under the MIT License. under THE mit-license", "cc by nc cc by nc by", "cc by-nc 4.0 Apache License, Version 2.0", "licensed under the mit licensee", "éunder the mit license", "x\u0001under the mit license"]
    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words, places = slow_base(t)
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        base = sorted({label for _, label in places})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_blocks_as_brute_force_finds_them(spark):
    rng = random.Random(2)
    templates = [("t1", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("t2", "one two three four five")]
    vocab = sorted({w for _, t in templates for w in t.split()}) + ["noise", "more"]
    texts = []
    for _ in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(40))]
        if rng.random() < 0.5:
            w += [x for x in rng.choice(templates)[1].split() if rng.random() < 0.93]
        texts.append(" ".join(w))
    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts), templates, 0.8, {}).collect()}
    for i, t in enumerate(texts):
        words, found = t.split(), {}
        for label, template in templates:
            want, width = set(template.split()), -(-len(template.split()) * 5 // 4)
            best = max((len(want & set(words[s : s + width])) for s in range(max(1, len(words)))), default=0)
            if best >= -(-len(want) * 8 // 10):
                found[label] = best / len(want)
        assert set(filter(None, rows[i]["labels"].split(","))) == set(found), t
        assert abs(rows[i]["score"] - max(found.values(), default=0)) < 1e-12


def test_near_notices(spark, nothing):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "this work is  licensed under the gnu general public license v 3", "the general public", "Released under the BSD License."]
    labels = [r["labels"] for r in licenses.scan(frame(spark, texts)).orderBy("doc_id").collect()]
    assert labels == ["gpl-3", "gpl-3", "", ""]
    assert licenses.scan(nothing).count() == 0


def test_places_of_many_phrases():
    ws = licenses.words("x cc by nc by " * 3 + "under the MIT license")
    found = licenses.phrase_places(ws, {b" cc by nc ": "c", b" under the mit license ": "m"})
    assert found == [(1, "c"), (6, "c"), (11, "c"), (15, "m")]
