"""Token ids in ORC files, written in the order of document ids, and read back.

Texts are range-partitioned by document id first (ids and texts only), encoded where they land, and written as
one ORC file for each partition in ascending order: file names, stripes and rows all follow the ids.
Added tokens of the tokenizer file that stand in a text have their own ids, as in the library.
ORC stores the ids as run-length encoded integers in stripes of ``stripe_bytes`` with row indexes and a Bloom filter on
``doc_id``, so readers take stripes in parallel and skip those a range or a point query cannot match.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changefeed.llm.common import Recent, keyed, materialise, partitions, worker_cache
from changefeed.llm.pieces import cut, marked
from changefeed.session import shared_dir

STRIPE_BYTES, INDEX_STRIDE = 16 << 20, 1000
MEMORY = 800_000
CHARACTERS_A_ROUND = 2_000_000
LONG_TEXT = 1 << 28  # an Arrow string column holds less than 2 GB


# Printable characters up to Latin Extended-B, white space but the plain space left out.
NEAR = re.compile("[ -~\xa1-\u024f]+").fullmatch
FAR = re.compile("[^\n -~\xa1-\u024f]").search


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next one from 256 on."""
    free = itertools.count(256)
    return [chr(b if 33 <= b <= 126 or b >= 161 and b != 173 else next(free)) for b in range(256)]


class Encoder:
    """A tokenizer of the public library in one worker. Pieces met before are looked up.

    Texts are cut at added tokens first (the leftmost, of those the longest); the parts between are independent texts.
    """

    def __init__(self, text: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        pre = json.loads(text).get("pre_tokenizer") or {}
        self.plain = json.loads(text).get("normalizer") is None and pre.get("type") == "ByteLevel"
        self.plain = self.plain and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = json.loads(text).get("added_tokens") or []
        self.plain = self.plain and not any(a.get(k) for a in added for k in ("lstrip", "rstrip", "single_word"))
        self.added = {a["content"]: np.array([a["id"]], "<u4").tobytes() for a in added}
        literals = "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))
        self.literals = re.compile(f"({literals})") if literals else None
        self.letters = dict(enumerate(_byte_letters()))
        self.matches = regex.compile(public_tokenizers.PATTERN)
        self.pieces = Recent(self._learn, MEMORY)
        self.tokenize, self.space = self.tokenizer.model.tokenize, self.letters[32]
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(20)]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _match(self, match: str) -> bytes:
        """The ids of one match of the pattern, by the library's model."""
        raw = match if match.isascii() else match.encode().decode("latin-1").translate(self.letters)
        found = self.tokenize(raw.replace(" ", self.space))
        return self.pack[len(found)](*[x.id for x in found]) if len(found) < len(self.pack) else array("I", [x.id for x in found]).tobytes()

    def _learn(self, x: str) -> bytes:
        """The ids of a new piece. One of Latin letters, on which all Unicode versions agree, is cut into matches of the
        pattern here and the library's model encodes each new match; another goes through the whole library."""
        if x in self.added:
            return self.added[x]
        if not x or not NEAR(x):
            return self._library([x])[0]
        if x[1:].isalpha() and (x[0] == " " or x[0].isalpha()):
            return self._match(x)
        word = x[:-1]
        if x[-1] in ",." and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            return self.pieces[word] + self.pieces[x[-1]]
        matches = self.matches.findall(x)
        return b"".join([self.pieces.get_or(m, self._match) for m in matches]) if len(matches) > 1 else self._match(x)

    def _cut(self, text: str) -> list[str]:
        if not any(x in text for x in self.added):
            return cut(text)
        parts = self.literals.split(text)  # every second part is an added token
        return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else cut(part) if part else [])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.plain:
            return [np.frombuffer(x, "<u4") for x in self._library(texts)]
        found = [None if not t or len(t) > LONG_TEXT or any(x in t for x in self.added) else marked(t) for t in texts]
        cuts = [self._cut(t) if t and f is None else [] for t, f in zip(texts, found)]
        lists = pc.split_pattern(pa.array([f for f in found if f is not None], pa.string()), "\0")
        coded = lists.flatten().dictionary_encode()  # each different piece becomes a Python string and is looked up once
        met = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), "\0")[0].as_py().split("\0")
        if any(map(FAR, texts)):
            self._learn_others({x for c in [met, *cuts] for x in c if not NEAR(x)})
        quick = iter(self._joined(met, coded.indices.to_numpy(), lists.offsets.to_numpy()))
        return [np.frombuffer(b"".join(itemgetter("", *c)(self.pieces)), "<u4") if f is None else next(quick) for f, c in zip(found, cuts)]

    def _learn_others(self, met: set[str]) -> None:
        others = [x for x in met if x not in self.added and not self.pieces.knows(x)]
        for i in range(0, len(others), 2000):  # many at a time cost less
            part = others[i : i + 2000]
            for x, ids in zip(part, self._library(part)):
                self.pieces.put(x, ids)

    def _joined(self, met: list[str], codes: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        """The ids of texts whose pieces are ``met[codes]``, those of a text from one of ``begins`` to the next."""
        ids = itemgetter("", *met)(self.pieces)[1:]
        size = np.fromiter(map(len, ids), np.int64, len(met)) // 4
        many = size[codes]
        ends = np.concatenate([[0], np.cumsum(many)])
        at = np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[codes] - ends[:-1], many)
        bounds = ends[begins].tolist()
        flat = np.frombuffer(b"".join(ids), "<u4")[at]
        return [flat[x:y] for x, y in zip(bounds, bounds[1:])]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Encode the texts (null: empty), append ``end_id`` and write doc_id, rid and ids in ascending order.

    Rows with equal ids follow each other by text, null ids come last. An empty table gives a readable, empty folder.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("tokens")
        if tokenizer_path not in cache:
            cache.clear()
            cache[tokenizer_path] = Encoder(held.value)
        encoder = cache[tokenizer_path]
        for b in batches:
            texts, at = b.column("text").to_pylist(), 0
            while at < len(texts):
                begin, size = at, 0
                while at < len(texts) and (size < CHARACTERS_A_ROUND or at == begin):
                    size += len(texts[at])
                    at += 1
                ids = encoder.encode(texts[begin:at])
                end = np.array([end_id], "<u4")
                flat = np.concatenate([y for x in ids for y in (x, end)]).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in ids])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                part = b.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), column], ["rid", "doc_id", "ids"])

    rows = keyed(docs).select("rid", "doc_id", "text")
    ordered = rows.repartitionByRange(partitions(docs), "rid").sortWithinPartitions("rid")
    encoded = ordered.mapInArrow(run, "rid long, doc_id long, ids array<int>")
    (
        encoded.write.format("orc")
        .option("compression", "snappy")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .save(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rid long, doc_id long, ids array<int>").orc(path)


def checked(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored row.

    The start is a running sum in two levels: over files, then within each file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("ids")
            flat, offsets = column.values.to_numpy(zero_copy_only=False).astype("<u4"), column.offsets.to_pylist()
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(offsets, offsets[1:])]
            n = [y - x for x, y in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), b.column("file"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                ["rid", "doc_id", "file", "n_tokens", "ids_crc32"],
            )

    named = stored.withColumn("file", F.input_file_name())
    rows = named.select("rid", "doc_id", "file", "ids").mapInArrow(
        run, "rid long, doc_id long, file string, n_tokens long, ids_crc32 long"
    )
    rows = materialise(rows, "token-rows")  # read twice below; the ids are read once
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("rid").alias("first"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "file")
    return placed.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    path = shared_dir(docs.sparkSession, "llm-tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return checked(read_tokens(docs.sparkSession, path))
