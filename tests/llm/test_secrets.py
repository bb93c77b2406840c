import random

from pyspark.sql import functions as F

from marlstone.llm import secrets

from .conftest import frame, prose


def corpus(spark, n=400):
    r = random.Random(7)
    texts = []
    for i in range(n):
        words = prose(40, i).split()
        hexes = "".join(r.choice("0123456789abcdef") for _ in range(40))
        if i % 4 == 0:
            words[10:10] = ["token", "=", f'"{hexes}"']
        elif i % 4 == 1:
            words[10:10] = ["commit", hexes]
        elif i % 4 == 2:
            words[10:10] = ["thequietwinterlightmorning"]
        texts.append(" ".join(words))
    return frame(spark, texts)


def test_false_positives_go(spark):
    rows = secrets.scan(corpus(spark)).collect()
    assert len(rows) == 300
    for r in rows:
        assert r["is_secret"] == int(r["doc_id"] % 4 == 0) and 0 <= r["score"] <= 1
    assert {r["before"] for r in rows if r["is_secret"]} == {"="}


def test_given_findings_are_learned(spark):
    docs = corpus(spark)
    findings = secrets.candidates(docs).select("doc_id", "word", (F.col("doc_id") % 4 == 1).cast("int").alias("label")).filter("doc_id < 300")
    rows = secrets.scan(docs, findings).filter("doc_id >= 300").collect()
    assert rows and all(r["is_secret"] == int(r["doc_id"] % 4 == 1) for r in rows)


def test_odd_rows(spark, odd, nothing):
    rows = secrets.scan(odd).collect()
    assert {r["candidate"] for r in rows} == {"x" * 5000}
    assert secrets.scan(nothing).count() == 0
    one = corpus(spark, 8).filter("doc_id = 0")
    assert secrets.scan(one, secrets.candidates(one).select("doc_id", "word", F.lit(1).alias("label"))).first()["score"] == 1.0


def test_all_candidates_of_a_word(spark):
    a, b = "0123456789abcdef" * 2, "fedcba9876543210" * 2
    rows = secrets.candidates(frame(spark, [f"  see key:{a},next:{b} end", f'{a}'])).orderBy("doc_id", "part").collect()
    assert [(r["doc_id"], r["word"], r["part"], r["candidate"], r["before"]) for r in rows] == [(0, 1, 0, a, "see"), (0, 1, 1, b, "see"), (1, 0, 0, a, "")]


def test_short_keys_and_words_that_hold_example_words(spark):
    key = "a1b2c3d4e5f6a7b8"
    after = {"end": 1, "entest": 1, "thatestion": 1, "test": 0, "sample.": 0, "test_key": 0, "testKey": 0, "EXAMPLES": 0, "xxxxxxxx": 0}
    texts = [f"api_key = {key} {w}" for w in after]
    rows = secrets.described(secrets.candidates(frame(spark, texts)), []).withColumn("label", secrets.rule_label()).collect()
    assert {list(after)[r["doc_id"]]: r["label"] for r in rows} == after


def slow_features(text, candidate, start, path, known_words):
    """FEATURES of a candidate that stands at ``start`` of a text, in plain Python."""
    import re

    words = text.split()
    at = len(text[:start].split()) - (0 if start == 0 or text[start - 1].isspace() else 1)
    get = lambda i: words[i] if 0 <= i < len(words) else ""
    token, n, low = words[at], len(candidate), candidate.lower()
    rest = re.sub("|".join(sorted(known_words, key=lambda w: (-len(w), w))), "", low) if known_words else low
    context = " ".join([get(at - 2), get(at - 1), re.sub(secrets.CANDIDATE, " ", token)])
    share = lambda p: len(re.findall(p, candidate)) / n
    example = r"(?:(?<![^\W\d_])|(?<=[a-z])(?=[A-Z]))(?i:examples?|samples?|dummy|dummies|tests?|testing|placeholders?|changeme|fixtures?|x{4,})(?![a-z])"
    runs = re.findall("[0-9]{6,}", candidate)
    return {
        "length": n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "hexes": share("[0-9a-f]"), "marks": share(r"[_+/=\-]"), "changes": share("[0-9](?=[A-Za-z])") + share("[A-Za-z](?=[0-9])"),
        "vowel_changes": share("(?i)[aeiou](?=[bcdfghjklmnpqrstvwxyz])") + share("(?i)[bcdfghjklmnpqrstvwxyz](?=[aeiou])"), "longest_digit_run": len(runs[0]) if runs else 0, "distinct": len(set(candidate)) / n, "coverage": 1 - len(rest) / n,
        "path_depth": path.count("/"), "path_example": bool(re.search(example, path)), "announced": bool(re.search(secrets.ANNOUNCING, context)), "assigned": bool(re.search("[=:]", context)), "quoted": bool(re.search("[\"'`]", token)),
        "before_length": len(get(at - 1)), "after_length": len(get(at + 1)), "example_near": bool(re.search(example, " ".join([context, get(at + 1)]))),
    }


def test_candidates_and_features_as_plain_python(spark):
    import re

    r = random.Random(11)
    made = ["token", "=", "test", "key:", '"', "a1b2c3d4", "abcdefgh", "ABCDEF0123456789", "the", "winter", "x" * 17, "1" * 20, "dGhlcXVpY2s9PQ==", "pass-word_12", "a/b/c/d/e/f/g/h/i", "password=hunter2abc", "id:9f8e7d6c5b4a39281706"]
    texts = [" ".join(r.choice(made) + r.choice(["", "", ",", ";", '"']) for _ in range(r.randrange(1, 14))) for _ in range(80)]
    known = ["the", "winter", "key"]
    docs = frame(spark, texts, ["src/test/x", "a", None])
    rows = secrets.described(secrets.candidates(docs), known).collect()
    want = {}
    for i, t in enumerate(texts):
        for m in re.finditer(secrets.CANDIDATE, t):
            want.setdefault(i, []).append((m.group(0), slow_features(t, m.group(0), m.start(), ["src/test/x", "a", ""][i % 3], known)))
    got = {}
    for x in sorted(rows, key=lambda x: (x["doc_id"], x["word"], x["part"])):
        got.setdefault(x["doc_id"], []).append(x)
    assert {i: [x["candidate"] for x in v] for i, v in got.items()} == {i: [c for c, _ in v] for i, v in want.items()}
    for i, v in want.items():
        for x, (_, features) in zip(got[i], v, strict=True):
            assert all(abs(x[f] - features[f]) < 1e-12 for f in secrets.FEATURES), (texts[i], x, features)


def test_planted_findings_held_out(spark):
    """The forest tells planted keys from their likes in texts that it hasn't seen, where no single feature does."""
    docs = corpus(spark)
    words = secrets.dictionary(docs)
    learned = secrets.planted_findings(spark, 3000, words)
    held = secrets.planted_findings(spark, 900, words, seed=1).cache()
    assert held.groupBy("kind").count().count() == 8 and held.count() >= 850
    model = secrets.train(learned)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = model.transform(VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(held)).select("kind", "label", (vector_to_array("probability")[1] >= 0.5).alias("called")).collect()
    caught = sum(r["called"] for r in rows if r["label"]) / sum(1 for r in rows if r["label"])
    right = sum(1 for r in rows if r["label"] and r["called"]) / sum(1 for r in rows if r["called"])
    assert caught > 0.93 and right > 0.93, (caught, right)


def test_null_paths_and_labels(spark):
    key = "0123456789abcdef" * 2
    docs = frame(spark, [f"token = {key}", f"commit {key}", None, ""], [None, None])
    findings = spark.createDataFrame([(0, 2, 1), (1, 1, None), (None, 1, 0), (7, 7, 0)], "doc_id bigint, word int, label int")
    rows = secrets.scan(docs, findings).collect()
    assert len(rows) == 2 and {r["score"] for r in rows} == {1.0} and {r["path"] for r in rows} == {""}
    assert {r["score"] for r in secrets.scan(docs, findings.filter("label is null")).collect()} == {0.5}
