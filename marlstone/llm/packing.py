"""Best-fit packing by a plan over the histogram of lengths.

Texts become token ids, an end id closes each document, and only documents over the sequence length are cut. What is
planned is the histogram of piece lengths (one number a length, whatever the number of documents): lengths from long
to short fill the open sequences with the least room that still holds them. The plan is a list of runs - so many
pieces of one length go to consecutive sequences, several to each, at one offset - and pieces take their slots by their
rank within their length.

Defined results: null text counts as empty and is the end id alone. Repeated rows are packed each. An empty table gives
an empty result. Extra columns are ignored. Only pieces and their CRCs leave the tokenizing tasks.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: Tokens of a sequence at most; the id that ends each document.
SEQUENCE_TOKENS, END_ID = 1024, 2
#: Twice as much white space in a row is safe from the fast library's limit on backtracking (some 10^6 characters).
SPACE_BLOCK = 50_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN_SCHEMA = "length long, first long, last long, per long, sequence long, place long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest in turn from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_ranks(vocabulary: dict) -> dict[bytes, int] | None:
    """Token bytes to ids, if the file's merges make tokens in the order of their ids (then an id is a merge's rank)."""
    to_byte, ids = byte_alphabet(), vocabulary["model"]["vocab"]
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in vocabulary["model"]["merges"]]
    places = [ids[t] for t in made]
    if places != sorted(places) or any(ids[c] >= places[0] for c in to_byte):
        return None
    added = {x["content"] for x in vocabulary.get("added_tokens", [])}
    return {bytes(to_byte[c] for c in t): i for t, i in ids.items() if t not in added}


def long_space(text: str, block: int = SPACE_BLOCK) -> bool:
    """Whether a whole block of the text is white space; every run of two blocks or more holds one."""
    return any(text[i : i + block].isspace() for i in range(0, len(text) - block + 1, block))


#: What a file must say beside its merges, so that the published pattern and plain byte pairs are all there is to it.
PLAIN = {"normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def is_plain(vocabulary: dict) -> bool:
    """Whether the file's texts are cut by the byte-level pattern and merged by ranks alone."""
    model = vocabulary["model"]
    return all(vocabulary.get(k) == v for k, v in PLAIN.items()) and all((model.get(k) or None) == (v or None) for k, v in PLAIN_MODEL.items())


class Encoder:
    """Ids of texts by the vocabulary file.

    The file's own library defines the ids. The same merges run several times faster in tiktoken, so texts go through
    that, unless they hold one of the file's special tokens or very long white space (the fast one panics on it), or the
    file's merges aren't in the order of their ids, or it cuts or changes texts in another way than the byte-level pattern.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        self.special = [x["content"] for x in vocabulary.get("added_tokens", [])]
        ranks = merge_ranks(vocabulary) if is_plain(vocabulary) else None
        self.fast = ranks and tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.fast and not any(x in text for x in self.special) and not long_space(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences at its end, what is left over first."""
    first = (length - 1) % most + 1
    return [(0, first), *[(s, most) for s in range(first, length, most)]]


def pieces(documents: DataFrame, tokenizer: str | None = None, most: int = SEQUENCE_TOKENS, end: int = END_ID) -> DataFrame:
    path = tokenizer or default_tokenizer()

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, closing = Encoder(path), np.array([end], "<u4").tobytes()
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                ids = encoder.ids(text or "") + closing
                out += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, most))]
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    docs = common.require(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInPandas(tokenize, PIECE_SCHEMA)


def plan(histogram: dict[int, int], most: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts: (length, first rank, last rank + 1, pieces a sequence, first sequence, offset).

    Sequences with the same room are runs of consecutive numbers. A length fills runs from the least room on, each
    sequence as often as it fits, and new sequences after that; a run is split where a length ends. Lengths are
    bounded by ``most``, so the plan's size is too, however many documents there are.
    """
    slots, sequences = [], 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # room: runs (first sequence, count)

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            rooms.setdefault(room, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = min((r for r in rooms if r >= length), default=0)
            if room:
                first, count = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            else:
                room, first, count = most, sequences, -(-left // (most // length))
                sequences += count
            per = room // length
            full = min(count, left // per)
            if full:
                slots.append((length, rank, rank + full * per, per, first, most - room))
                leave(room - per * length, first, full)
                rank, left, first, count = rank + full * per, left - full * per, first + full, count - full
            if left and count:  # the last few share one sequence
                slots.append((length, rank, rank + left, left, first, most - room))
                leave(room - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            leave(room, first, count)
    return slots


def pack(documents: DataFrame, tokenizer: str | None = None, most: int = SEQUENCE_TOKENS, end: int = END_ID) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = documents.sparkSession
    cutting = common.settle(pieces(documents, tokenizer, most, end), "pieces")
    counts = {r["length"]: r["count"] for r in cutting.groupBy("length").count().collect()}  # `most` rows at most
    slots = plan(counts, most)
    planned = spark.createDataFrame(pd.DataFrame(slots, columns=["length", "first", "last", "per", "sequence", "place"]), PLAN_SCHEMA).withColumnRenamed("length", "l") if slots else common.empty(spark, PLAN_SCHEMA).withColumnRenamed("length", "l")
    ranked = common.spread_rank(cutting, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank", parts=max(256, min(65536, cutting.count() // 4096)))
    # The plan's size is bounded by the sequence length, so it may be broadcast at any size of the input.
    placed = ranked.join(F.broadcast(planned), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    index = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(index / F.col("per"))).cast("long").alias("sequence_id"), (F.col("place") + (index % F.col("per")) * F.col("length")).cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """Each sequence with its pieces in order: sequence_id, tokens, pieces (doc_id, start, length)."""
    piece = F.struct("offset", "doc_id", "start", "length")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.array_sort(F.collect_list(piece)).alias("pieces"))
