"""Secret scans: a random forest removes the false positives of a wide candidate pattern, with DataFrame operations alone.

Candidates are runs of key-like characters, from 16 on, or from 8 on if they mix letters and digits. Each has features of
its length, its character transitions, how much of it dictionary words cover (words that are frequent in the corpus
itself), its path, and the words beside it. A random forest of Spark's own, trained on a bounded number of labelled
findings, scores every candidate.

Where no labelled findings are given, they are planted: texts of the corpus' own frequent words in which either a made-up
key stands where keys stand, or something that only looks like one (a commit, a checksum, an identifier, a long word, a
number, an example). What was planted is known by its making, not by a rule over the features.

Defined results: null text counts as empty and a null path as the empty one; documents without candidates have no rows.
Repeated rows are scanned each. If the labelled findings are of one kind only, every candidate scores as that kind;
if they are given and empty, candidates score 0.5. Findings without a label are left out. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common

#: What a candidate may be made of, and how long it is at least; padding may end it.
CANDIDATE = (
    r"(?<![A-Za-z0-9_+/\-])(?:[A-Za-z0-9_+/\-]{16,}={0,2}"
    r"|(?=[A-Za-z_+/\-]{0,14}[0-9])(?=[0-9_+/\-]{0,14}[A-Za-z])[A-Za-z0-9_+/\-]{8,15}(?![A-Za-z0-9_+/\-]))"
)
#: Characters of the shortest candidate.
SHORTEST = 8
#: Labelled findings that the forest is trained on, at most; planted ones; words of the dictionary; trees and their depth.
FINDINGS, PLANTED, DICTIONARY, TREES, DEPTH = 20_000, 8_000, 400, 24, 8

#: Words that announce a secret, and words that announce an example (fixed values).
ANNOUNCING = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private)"
#: An example's word stands alone: next to it are no letters, or a capital begins a new word (``testKey``, ``myTest``); in
#: the name of a host or an address (``x@mail.example.com``) it says nothing.
EXAMPLE = r"(?:(?<![\p{L}.@])|(?<=\p{Ll})(?=\p{Lu}))(?i:examples?|samples?|dummy|dummies|tests?|testing|placeholders?|changeme|fixtures?|x{4,})(?!\p{Ll}|\.\p{L})"

FEATURES = ["length", "digits", "uppers", "hexes", "marks", "changes", "vowel_changes", "longest_digit_run", "distinct", "coverage", "path_depth", "path_example", "announced", "assigned", "quoted", "before_length", "after_length", "example_near"]


def candidates(documents: DataFrame, path_col: str = "source") -> DataFrame:
    """doc_id, path, word (index from 0), part, candidate, token, before, before2, after: one row for each candidate.

    A word such as a URL may hold several candidates; ``part`` counts them from 0.
    """
    docs = common.require(documents, "doc_id", "text", *({path_col} - {"doc_id", "text"}))
    docs = docs.select("doc_id", F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), common.text_or_empty().alias("body"))
    docs = docs.filter(F.col("body").rlike(CANDIDATE)).withColumn("w", F.split(F.regexp_replace("body", f"^[{common.SPACE_CLASS}]+", ""), f"[{common.SPACE_CLASS}]+"))
    at = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    near = F.filter(
        F.transform("w", lambda x, i: F.when((F.length(x) >= SHORTEST) & x.rlike(CANDIDATE), F.struct(i.alias("word"), x.alias("token"), at(i - 1).alias("before"), at(i - 2).alias("before2"), at(i + 1).alias("after")))),
        lambda x: x.isNotNull())
    rows = docs.select("doc_id", "path", F.explode(near).alias("c")).select("doc_id", "path", "c.*")
    return rows.select("*", F.posexplode(F.regexp_extract_all("token", F.lit(CANDIDATE), F.lit(0))).alias("part", "candidate"))


def dictionary(documents: DataFrame, words: int = DICTIONARY) -> list[str]:
    """The words of 3 to 12 letters that most documents have: counts over all of them, ``words`` rows come back."""
    letters = F.regexp_replace(F.lower(common.text_or_empty()), r"[^\p{L}]+", " ")
    each = documents.select(F.explode(F.array_distinct(F.split(letters, " "))).alias("word")).filter(F.length("word").between(3, 12))
    return [r["word"] for r in each.groupBy("word").count().orderBy(F.desc("count"), "word").limit(words).collect()]


def _share(column: str, pattern: str) -> Column:
    return F.regexp_count(F.col(column), F.lit(pattern)) / F.length(column)


def described(found: DataFrame, known_words: list[str]) -> DataFrame:
    """The candidates with FEATURES."""
    low = F.lower("candidate")
    rest = low
    if known_words:
        by_length = sorted(known_words, key=lambda w: (-len(w), w))
        rest = F.regexp_replace(low, "|".join(by_length), "")
    context = F.concat_ws(" ", "before2", "before", F.regexp_replace("token", CANDIDATE, " "))
    return found.select(
        "*",
        F.length("candidate").cast("double").alias("length"), _share("candidate", "[0-9]").alias("digits"), _share("candidate", "[A-Z]").alias("uppers"), _share("candidate", "[0-9a-f]").alias("hexes"),
        _share("candidate", r"[_+/=\-]").alias("marks"), (_share("candidate", "[0-9](?=[A-Za-z])") + _share("candidate", "[A-Za-z](?=[0-9])")).alias("changes"),
        (_share("candidate", "(?i)[aeiou](?=[bcdfghjklmnpqrstvwxyz])") + _share("candidate", "(?i)[bcdfghjklmnpqrstvwxyz](?=[aeiou])")).alias("vowel_changes"),
        F.length(F.regexp_extract("candidate", "([0-9]{6,})", 1)).cast("double").alias("longest_digit_run"), (F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate")).alias("distinct"),
        (1 - F.length(rest) / F.length("candidate")).alias("coverage"),
        _count("path", "/").alias("path_depth"), F.col("path").rlike(EXAMPLE).cast("double").alias("path_example"),
        context.rlike(ANNOUNCING).cast("double").alias("announced"), context.rlike("[=:]").cast("double").alias("assigned"), F.col("token").rlike("[\"'`]").cast("double").alias("quoted"),
        F.length("before").cast("double").alias("before_length"), F.length("after").cast("double").alias("after_length"), F.concat_ws(" ", context, F.col("after")).rlike(EXAMPLE).cast("double").alias("example_near"))


def _count(column: str, pattern: str) -> Column:
    return F.regexp_count(F.col(column), F.lit(pattern)).cast("double")


def rule_label() -> Column:
    """A plain rule to hold a forest against: a finding is true if a secret's name is assigned to it and it mixes letters and digits."""
    mixed = F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")
    return ((F.col("announced") > 0) & (F.col("assigned") > 0) & (F.col("example_near") == 0) & mixed).cast("double")


#: Names that keys are given, and names of what only looks like a key (made up for planting).
SECRET_NAMES = ["token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "credentials", "db_password", "TOKEN", "API_KEY", "SECRET"]
OTHER_NAMES = ["commit", "checksum", "sha1", "md5", "etag", "id", "uuid", "revision", "build", "digest", "order", "file", "ref", "COMMIT", "ID"]
EXAMPLE_WORDS = ["example", "sample", "dummy", "placeholder", "test"]
PATHS = ["src0", "app/settings", "config/service.env", "lib/core/client", "notes"]


def planted(spark: SparkSession, rows: int, known_words: list[str], seed: int = 0) -> DataFrame:
    """doc_id, text, source, kind, value, label: texts that hold one candidate each, which is a key (label 1) or only looks like one."""
    vocabulary = known_words or ["the", "and", "that", "with", "from", "this", "have", "which"]
    draw = lambda i, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(n))
    pick = lambda i, options: F.element_at(F.array(*[F.lit(o) for o in options]), (draw(i, len(options)) + 1).cast("int"))
    hexes = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))), 256)
    words = lambda i, n: F.concat_ws(" ", *[pick(i + j, vocabulary) for j in range(n)])
    some = lambda i, n: F.array(*[pick(i + j, vocabulary) for j in range(n)])
    # Settled in two steps, so that what later steps choose from is made once.
    parts = common.settle(spark.range(rows).select(
        "id", hexes.alias("hex"), F.translate(F.base64(F.unhex(hexes)), "=\r\n", "").alias("code"), some(200, 8).alias("some"), words(300, 6).alias("left"), words(310, 5).alias("right"), pick(11, vocabulary).alias("own"),
        pick(9, SECRET_NAMES).alias("secret"), pick(10, OTHER_NAMES).alias("other"), pick(13, EXAMPLE_WORDS).alias("example"), pick(16, PATHS).alias("source")), "planted-parts")
    code, letters = F.translate("code", "+/", "xy"), F.array_join("some", "")
    one_of = lambda i, values: F.element_at(F.array(*values), (draw(i, len(values)) + 1).cast("int"))
    short = F.concat(F.substring(code, 1, 6), F.substring("hex", 7, 1), F.lit("7a"), F.substring("code", 9, 3))
    strong = one_of(1, [F.col("hex"), F.substring("hex", 1, 40), F.substring("hex", 1, 32), F.upper(F.substring("hex", 1, 40)), F.col("code"), F.substring(code, 1, 24), F.concat(F.lit("AKIA"), F.upper(F.substring(code, 1, 16))), short])
    weak = one_of(6, [
        F.substring(letters, 1, 24), F.substring(letters, 1, 17), F.array_join(F.slice("some", 1, 5), "_"), F.array_join(F.slice("some", 4, 5), "/"), F.repeat(F.lit("x"), 20), F.lpad(draw(3, 10**15).cast("string"), 16, "4"),
        F.concat(F.col("some")[0], F.lit("-2024-01-1"), draw(4, 10).cast("string")), F.concat(F.substring(letters, 1, 9), draw(5, 90).cast("string"))])
    made = common.settle(parts.withColumn("strong", strong).withColumn("weak", weak), "planted-values")
    strong, weak, secret, other = (F.col(c) for c in ("strong", "weak", "secret", "other"))
    assign = pick(7, [" = ", ": ", "=", " := ", ":", " : "])
    quoted = lambda v: F.concat(pick(8, ["", '"', "'", '"']), v, pick(8, ["", '"', "'", '";']))
    kinds = [
        (1, "key", strong, F.concat(secret, assign, quoted(strong))),
        (1, "key", strong, F.concat(secret, assign, quoted(strong))),
        (1, "key in a name", strong, F.concat(F.col("own"), F.lit("_"), secret, assign, quoted(strong))),
        (0, "other name", strong, F.concat(other, pick(12, [" ", " = ", ": ", "="]), quoted(strong))),
        (0, "in prose", strong, strong),
        (0, "example", strong, F.concat(secret, assign, quoted(strong), F.lit(" "), F.col("example"))),
        (0, "words", weak, weak),
        (0, "words after a name", weak, F.concat(secret, pick(14, [" ", ": ", " = "]), weak)),
        (0, "other words", weak, F.concat(other, pick(15, [" ", ": ", " = "]), quoted(weak))),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    choose = lambda at: reduce(lambda rest, i: F.when(kind == i, kinds[i][at] if isinstance(kinds[i][at], Column) else F.lit(kinds[i][at])).otherwise(rest), range(len(kinds)), F.lit(None))
    text = F.concat_ws(" ", "left", choose(3), "right")
    return made.select(F.col("id").alias("doc_id"), text.alias("text"), "source", choose(1).alias("kind"), choose(2).alias("value"), choose(0).cast("double").alias("label"))


def planted_findings(spark: SparkSession, rows: int, known_words: list[str], seed: int = 0) -> DataFrame:
    """The candidates of planted texts that hold what was planted (candidates, FEATURES, kind and label)."""
    made = planted(spark, rows, known_words, seed)
    found = described(candidates(made), known_words)
    named = made.select(F.col("doc_id").alias("_d"), "value", "kind", "label")
    return found.join(named, (F.col("doc_id") == F.col("_d")) & F.col("value").contains(F.rtrim(F.col("candidate"), F.lit("=")))).drop("_d", "value")


def train(labelled: DataFrame, most: int = FINDINGS):
    """A forest from (FEATURES, label), or the label itself where all findings have the same one. Findings beyond ``most`` are left out by hash."""
    counts = {r["label"]: r["count"] for r in labelled.filter("label is not null").groupBy("label").count().collect()}
    if len(counts) < 2:
        return next(iter(counts), 0.5)
    keys = [F.col(c) for c in ("candidate", "doc_id", "word", "part")]
    bounded = common.sample_by_hash(labelled.filter("label is not null"), most, keys, sum(counts.values())).select(*FEATURES, "label")
    sample = common.settle(bounded.coalesce(1), "findings")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=42, maxMemoryInMB=64)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))


def scan(documents: DataFrame, labelled: DataFrame | None = None, path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, word, part, candidate, score, is_secret, path, before, after: every candidate with the forest's verdict.

    labelled: (doc_id, word, label) names findings by document and word index, and by part if it has that column. Without it
    the forest learns from PLANTED texts.
    """
    known_words = dictionary(documents)
    found = common.settle(described(candidates(documents, path_col), known_words), "candidates")
    if labelled is None:
        learned = common.settle(planted_findings(documents.sparkSession, PLANTED, known_words), "planted")
    else:
        part = F.col("part") if "part" in labelled.columns else F.lit(None).cast("int")
        named = labelled.select(F.col("doc_id").alias("_d"), F.col("word").alias("_w"), part.alias("_p"), F.col("label").cast("double").alias("label"))
        learned = found.join(named, (F.col("doc_id") == F.col("_d")) & (F.col("word") == F.col("_w")) & F.coalesce(F.col("part") == F.col("_p"), F.lit(True)))
    model = train(learned)
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word", "part", "candidate", F.round("score", 9).alias("score"), (F.col("score") >= threshold).cast("int").alias("is_secret"), "path", "before", "after")
