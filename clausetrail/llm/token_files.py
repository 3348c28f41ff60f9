"""Token ids in ORC: run-length coded integers, row indexes and Bloom filters on the document id.

``write_tokens`` puts documents in ascending id order into ORC files.  ORC stores the ids of a
column as run-length coded integers, keeps minimum and maximum of ``doc_id`` for every stripe and
row group, and here also a Bloom filter, so a reader that asks for some documents skips whole
stripes (``read_documents``).  Large files are read stripe by stripe, in parallel.

Every row carries the ordinal of the file part it was written by and its offset inside that part.
The offset over all documents is then the sum of the parts before it, which is one small row per
part; nothing has to number all documents in one task.

Defined results: a null text is an empty text; an empty text is the end id alone; a null ``doc_id``
sorts first; rows with equal ``doc_id`` follow each other ordered by a hash of their text, and rows
equal in both may change places (they are the same row); an empty table gives files without rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from clausetrail.llm.common import crc32, prepare

# Chunks that stay known in a worker, about 200 bytes each; later new ones are encoded every time.
KNOWN_CHUNKS = 1_000_000
FILE_SCHEMA = "doc_id bigint, part bigint, part_start bigint, n_tokens bigint, ids array<int>"

# White space that cuts at single characters don't handle: control and Unicode white space, runs of
# three, and runs of two that end the text.
_UNUSUAL_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_TWO_BLANKS = re.compile("[ \t-\r]{2}")
_UNUSUAL_RUN = re.compile("[ \t-\r]{2}(?:[ \t-\r]|\\Z)")
_BLANKS = " \t\n\r\x0b\x0c"
_STOPS = ".,"


class ChunkEncoder:
    """Encodes whole texts; each chunk goes through the tokenizer once.

    A byte-level BPE splits a text before it merges, and it always splits before a blank or a line feed
    in a run of at most two white space characters before other text, and between an ASCII letter or
    digit and a stop that ends a chunk.  So a text's ids are those of its chunks, one after the other.
    A chunk is " word", or "\nword" where a line starts.  Texts with other white space, or with a special
    token's string, are encoded whole.
    """

    def __init__(self, path: str, known_chunks: int = KNOWN_CHUNKS):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splitter = spec.get("pre_tokenizer") or {}
        self.cuts = (
            spec.get("normalizer") is None
            and splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True)
            and not splitter.get("add_prefix_space", False)
        )
        self.specials = [token["content"] for token in spec.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)
        self.known_chunks = known_chunks
        self.known: dict[str, bytes] = {}
        self.stops = {stop: self.whole(stop) for stop in _STOPS}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str], out: dict[str, bytes]) -> None:
        """Adds the ids of these chunks; where their ends allow it, all go through the tokenizer as one text."""
        joined = []
        for word in words:
            if word and word[-1] not in _BLANKS:
                joined.append(word)
            else:
                out[word] = self.whole(word if word[:1] == "\n" else " " + word)
        if joined:
            pieces = [word if word[0] == "\n" else " " + word for word in joined]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(np.fromiter((len(x.encode()) for x in pieces), np.int64, len(pieces)))
            cuts = (4 * (1 + np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, "left"))).tolist()
            raw, at = ids.tobytes(), 0
            for word, cut in zip(joined, cuts):
                out[word] = raw[at:cut]
                at = cut

    def _divides(self, text: str) -> bool:
        """True where the text is the sum of its chunks."""
        if _UNUSUAL_SPACE.search(text) or any(s in text for s in self.specials):
            return False
        return not (_TWO_BLANKS.search(text) and _UNUSUAL_RUN.search(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.cuts:
            return [self.whole(text) for text in texts]
        get = self.known.get
        divided: list[tuple[list[str], list[bytes | None], list[int]] | None] = []
        new: set[str] = set()
        for text in texts:
            if not self._divides(text):
                divided.append(None)
                continue
            words = text.replace("\n", " \n").split(" ")
            ids = list(map(get, words))
            ids[0] = self.whole(words[0])  # nothing stands before it
            open_ = [i for i, known in enumerate(ids) if known is None]
            new.update([words[i] for i in open_])
            divided.append((words, ids, open_))
        stopped = [w for w in new if w[-1:] in self.stops and w[-2:-1].isascii() and w[-2:-1].isalnum()]
        new.difference_update(stopped)
        found: dict[str, bytes] = {}
        self._learn([w for w in new.union(w[:-1] for w in stopped) if w not in self.known], found)
        for word in stopped:
            found[word] = (get(word[:-1]) or found[word[:-1]]) + self.stops[word[-1]]
        if len(self.known) + len(found) <= self.known_chunks:
            self.known.update(found)
        out = []
        for text, parts in zip(texts, divided):
            if parts is None:
                out.append(self.whole(text))
                continue
            words, ids, open_ = parts
            for i in open_:
                ids[i] = found[words[i]]
            out.append(b"".join(ids))
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per worker process, so what it has learnt serves later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _encode_partition(tokenizer_path: str, end_id: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end, start = encoder(tokenizer_path).encode, np.array([end_id], "<u4").tobytes(), 0
        part = TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                ids = [x + end for x in encode([t or "" for t in batch.column(1).to_pylist()])]
                sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()),
                        pa.array(np.full(len(ids), part, np.int64)),
                        pa.array(starts),
                        pa.array(sizes),
                        _lists(ids),
                    ],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 0,
    stripe_bytes: int = 64 << 20,
    index_rows: int = 1_000,
    bloom_false_positives: float = 0.01,
    rows_per_call: int = 256,
) -> None:
    """Encodes ``text`` of ``docs`` and writes ORC files in ascending ``doc_id`` order.

    Texts are dealt by ranges of (doc_id, hash of the text) and encoded after that, as ids take more
    room than text.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_encode_partition(tokenizer_path, end_id, rows_per_call), FILE_SCHEMA)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_false_positives))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as they are: doc_id, part, part_start, n_tokens, ids."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Some documents; stripes whose statistics or Bloom filter exclude them are not read."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def part_offsets(tokens: DataFrame) -> DataFrame:
    """Ids before each part; one row per part that holds rows."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = tokens.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    return sizes.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_offset"))


@F.arrow_udf(LongType())
def _ids_crc32(ids: pa.Array) -> pa.Array:
    return pa.array([crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for x in ids], pa.int64())


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files.

    The offsets are one row for each part, so at most as many rows as there were write tasks.
    """
    tokens = read_tokens(spark, path)
    return tokens.join(F.broadcast(part_offsets(tokens)), "part").select(
        "doc_id",
        (F.col("part_offset") + F.col("part_start")).cast("bigint").alias("start"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        _ids_crc32("ids").alias("ids_crc32"),
    )
