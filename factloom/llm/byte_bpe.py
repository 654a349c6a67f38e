"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding. The tasks that read the documents split whole texts into pre-tokens ("words") and note each word's place: a
segment holds a slice of documents as places in its own list of distinct words. The distinct words of a segment, dealt
to ``SHARDS`` shards by hash, are shuffled by shard, so all segments' copies of a word meet; each is encoded once, and its
ids go back to the segments that sent it. A segment sends a word once, however often the texts hold it, so the most usual word
is one entry a segment. The segments themselves stay where they are: their table is bucketed by segment, only words and
ids move. A text's ids are its words' ids, gathered by place.

Decoding. Ids join the token-byte table by id: in the tasks, as the table is sent within ``VOCABULARY`` rows, by a Spark
join of exploded ids beyond that. Where both are asked for at once, the tasks that gather ids spell them too.

Pieces of white space, contractions and the rest are split as the public pattern says; a piece splits into itself alone, so
encoding it apart gives the ids it has in its text.

Edge cases: a null or empty text has no ids and decodes to no bytes. Repeated rows and null ids of documents keep a row
each. An empty table gives an empty table. Other columns, whatever they are called, are not read. A text longer than a segment is a
segment of its own.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import token_files
from factloom.storage import Scratch, table

#: Characters of texts in a segment, about.
SEGMENT = 12_000_000
#: Rows by which a segment sends its distinct words.
SHARDS = 1024
#: Words of a shard whose ids a task remembers; more are encoded again.
CACHE = 500_000
#: Rows of a token-byte table that is sent to all tasks.
VOCABULARY = 1_000_000
#: Pre-tokens, or ids, of a text that are gathered at once.
STEP = 1_000_000
_END = b"\xff"  # never in UTF-8


def ranks_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    return token_files.vocabulary_file(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """ranks: lines of a token in base64 and its id."""
    listed = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=listed, special_tokens={})


class Splitter:
    """Texts -> pre-tokens; texts of Latin-1 characters by the standard library, several times as fast, if the pattern is the public one."""

    def __init__(self, pattern: str, public: str):
        self.plain = re.compile("(?!)") if pattern != public else token_files._PIECES
        self.other = re.compile("") if pattern != public else token_files._OTHER
        self.any = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        return (self.any if self.other.search(text) else self.plain).findall(text)


class _Places(dict):
    """Words -> places, in the order of their first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def pack(x: np.ndarray) -> bytes:
    """Numbers below 2^32, lowest bytes first: high bytes, mostly zero, stand together and compress away."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def segments(docs: DataFrame, pattern: str, *, text: str = "text", doc_id: str = "doc_id", segment: int = SEGMENT, shards: int = SHARDS) -> DataFrame:
    """(segment, doc_ids, n, places, shards, words): ``n`` words of each document, all words as places in the segment's distinct words, the
    most frequent first; the shard of each distinct word; and the words by shard.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    public = globals()["pattern"]()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part, made = Splitter(pattern, public), TaskContext.get().partitionId(), 0
        known, ids, n, held, chars = _Places(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal known, ids, n, held, chars, made
            at = np.concatenate([*held, np.empty(0, np.int64)]).astype(np.int64)
            by_use = np.argsort(-np.bincount(at, minlength=len(known)), kind="stable")
            place = np.empty(len(known), np.int64)
            place[by_use] = np.arange(len(known))
            spelled = [w.encode("utf-8", "surrogatepass") for w in known]
            spelled = [spelled[k] for k in by_use.tolist()]
            shard = np.fromiter((xxhash.xxh64_intdigest(w) % shards for w in spelled), np.int64, len(spelled))
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards), side="right").tolist()
            ordered = [spelled[k] for k in order.tolist()]
            words = [b"".join(w + _END for w in ordered[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            row = [pa.array([part << 32 | made]), pa.array([ids], pa.list_(id_type)), pa.array([n], pa.list_(pa.int32())), pa.array([pack(place[at])]), pa.array([pack(shard)]), pa.array([words], pa.list_(pa.binary()))]
            known, ids, n, held, chars, made = _Places(), [], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays(row, ["segment", "doc_ids", "n", "places", "shards", "words"])

        for b in batches:
            id_type = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or ""
                if ids and chars + len(t) > segment:
                    yield flush()
                pieces = split(t)
                ids.append(i), n.append(len(pieces)), held.append(np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces)))
                chars += len(t)
        if ids:
            yield flush()

    schema = f"segment long, doc_ids array<{kind}>, n array<int>, places binary, shards binary, words array<binary>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _bucketed(df: DataFrame, scratch: Scratch, name: str, key: str) -> DataFrame:
    """``df`` written to the job's folder in buckets of the key, so that a join on it doesn't move these rows."""
    spark, entry = df.sparkSession, f"factloom_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", f"{scratch.root}/{name}").option("compression", "zstd").bucketBy(n, key).saveAsTable(entry)
    return spark.table(entry)


def encode(docs: DataFrame, ranks: str, *, text: str = "text", doc_id: str = "doc_id", pattern: str | None = None, segment: int = SEGMENT, shards: int = SHARDS, vocabulary: DataFrame | None = None, most: int = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens long, ids binary) of every row; ids as little-endian unsigned 32-bit integers. ranks: a file of tokens and ids, read by the driver.

    With a ``vocabulary``, ``decoded`` is the fourth column, as ``decode`` makes it of the ids; within ``most`` rows by the workers that gather them, as a
    task that decodes after another Python step holds two workers.
    """
    spelling = None if vocabulary is None else _sent(vocabulary, most)
    if vocabulary is not None and spelling is None:
        tokens = encode(docs, ranks, text=text, doc_id=doc_id, pattern=pattern, segment=segment, shards=shards)
        return _joined(tokens.withColumn("kept", F.col("ids")), vocabulary).withColumnRenamed("kept", "ids")
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    pattern = pattern or globals()["pattern"]()
    with open(ranks, "rb") as f:  # a parameter of the job, as large as a vocabulary
        sent = spark.sparkContext.broadcast(f.read())
    cut = _bucketed(segments(docs, pattern, text=text, doc_id=doc_id, segment=segment, shards=shards), scratch, "segments", "segment")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(sent.value, pattern)
        known: dict[bytes, list[int]] = {}
        last = None
        for b in (batch.slice(k, 1000) for batch in batches for k in range(0, len(batch), 1000)):
            sizes, ids = [], []
            for shard, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if shard != last or len(known) > CACHE:  # a word has one shard
                    known, last = {}, shard
                got = []
                for w in blob.split(_END)[:-1]:
                    if (x := known.get(w)) is None:
                        x = known[w] = enc.encode_ordinary(w.decode("utf-8", "surrogatepass"))
                    got.append(x)
                sizes.append(pack(np.fromiter(map(len, got), np.int64, len(got))))
                ids.append(pack(np.array([i for x in got for i in x], np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["segment", "shard", "sizes", "ids"])

    words = cut.select("segment", F.posexplode("words").alias("shard", "words")).where(F.length("words") > 0)
    coded = words.repartition("shard").sortWithinPartitions("shard").mapInArrow(once, "segment long, shard int, sizes binary, ids binary")
    back = coded.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("shard", "sizes", "ids"))).alias("coded"))  # at most ``shards`` entries
    both = cut.select("segment", "doc_ids", "n", "places", "shards").join(back, "segment", "left").drop("segment")
    kind = docs.schema[doc_id].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = None if spelling is None else _speller(spelling.value)
        for b in batches:
            for r in range(len(b)):
                row = b.slice(r, 1)
                coded = row.column("coded")[0].as_py() or []
                shard = unpack(row.column("shards")[0].as_py())
                sizes = np.empty(len(shard), np.int64)
                order = np.argsort(shard, kind="stable")
                sizes[order] = in_order = np.concatenate([np.empty(0, np.int64), *(unpack(x["sizes"]) for x in coded)])
                starts = np.empty(len(shard), np.int64)
                starts[order] = np.cumsum(in_order) - in_order
                flat = np.concatenate([np.empty(0, "<u4"), *(unpack(x["ids"]) for x in coded)])
                places, n = unpack(row.column("places")[0].as_py()), row.column("n").flatten().to_numpy(zero_copy_only=False)
                names, at, done, out, spelt, held = row.column("doc_ids").flatten(), 0, 0, [], [], 0
                for k, m in enumerate(n.tolist()):
                    out.append(b"".join(_taken(flat, starts, sizes, places[x : min(x + STEP, at + m)]) for x in range(at, at + m, STEP)))
                    if spell is not None:
                        spelt.append(spell(out[-1]))
                    at, held = at + m, held + len(out[-1])
                    if held > 4_000_000 or k == len(n) - 1:
                        made = {"doc_id": names.slice(done, len(out)), "n_tokens": pa.array([len(x) // 4 for x in out]), "ids": pa.array(out, pa.binary())}
                        yield pa.RecordBatch.from_pydict(made if spell is None else made | {"decoded": pa.array(spelt, pa.binary())})
                        done, out, spelt, held = k + 1, [], [], 0

    return both.mapInArrow(gather, f"doc_id {kind}, n_tokens long, ids binary" + ("" if spelling is None else ", decoded binary"))


def _taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> bytes:
    """The runs of ``flat`` that ``at`` names, in a row."""
    n = sizes[at]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[at] - ends + n, n) + np.arange(int(ends[-1]))].tobytes() if len(n) else b""


def token_table(spark: SparkSession, ranks: str) -> DataFrame:
    """(id, token binary) of a file of ranks."""
    with open(ranks, "rb") as f:
        rows = [(int(b), bytearray(base64.b64decode(a))) for a, b in map(bytes.split, f)]
    return spark.createDataFrame(rows, "id long, token binary")


def _sent(vocabulary: DataFrame, most: int) -> Broadcast | None:
    """The vocabulary(id, token) for ``_speller``, sent to all tasks; None beyond ``most`` rows."""
    held = vocabulary.select("id", "token").limit(most + 1).collect()  # a bounded table
    if len(held) > most:
        return None
    size = max((r["id"] for r in held), default=-1) + 1
    length, named = np.full(size, -1, np.int64), sorted((r["id"], bytes(r["token"])) for r in held)
    for i, t in named:
        length[i] = len(t)
    starts = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    return vocabulary.sparkSession.sparkContext.broadcast((b"".join(t for _, t in named), starts, length))


def _speller(sent: tuple[bytes, np.ndarray, np.ndarray]) -> Callable[[bytes], bytes]:
    """Ids, as little-endian unsigned 32-bit integers -> the bytes of their tokens."""
    spelled, starts, length = sent
    flat = np.frombuffer(spelled, np.uint8)

    def some(ids: np.ndarray) -> bytes:
        if len(ids) and (int(ids.max()) >= len(length) or (length[ids] < 0).any()):
            raise ValueError("an id that the vocabulary doesn't have")
        return _taken(flat, starts, length, ids)

    def spell(x: bytes) -> bytes:
        ids = np.frombuffer(x, "<u4")
        return b"".join(some(ids[i : i + STEP]) for i in range(0, len(ids), STEP))

    return spell


def decode(tokens: DataFrame, vocabulary: DataFrame, *, most: int = VOCABULARY) -> DataFrame:
    """tokens(ids, and others) with ``decoded``, the bytes of their ids' tokens, in place of the ids. An id that the vocabulary(id, token) doesn't have is an error."""
    sent = _sent(vocabulary, most)
    if sent is None:
        return _joined(tokens, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = _speller(sent.value)
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.slice(k, 256)
                decoded = [spell(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(decoded, pa.binary())], [*others, "decoded"])

    others = [c for c in tokens.columns if c != "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != "ids")
    return tokens.mapInArrow(run, f"{schema}, decoded binary")


def _joined(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Decoding by a join on the id, for vocabularies too large to send."""
    row = Scratch(tokens.sparkSession, "decode").save(tokens.withColumn("_row", F.monotonically_increasing_id()), "rows")
    each = row.select("_row", F.posexplode(F.regexp_extract_all(F.hex("ids"), F.lit(".{8}"), 0)).alias("at", "hex"))
    swapped = F.concat(*(F.substring("hex", k, 2) for k in (7, 5, 3, 1)))
    each = each.select("_row", "at", F.conv(swapped, 16, 10).cast("long").alias("id")).join(vocabulary, "id", "left")
    known = F.when(F.col("token").isNull(), F.raise_error(F.lit("an id that the vocabulary doesn't have")).cast("string")).otherwise(F.hex("token"))
    spelled = each.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", known.alias("hex")))).alias("x"))
    spelled = spelled.select("_row", F.unhex(F.array_join(F.transform("x", lambda y: y["hex"]), "")).alias("decoded"))
    return row.join(spelled, "_row", "left").withColumn("decoded", F.coalesce("decoded", F.lit(b""))).drop("_row", "ids")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = encode(table(spark, sf_dir, "documents"), ranks_file(), vocabulary=token_table(spark, ranks_file()))
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
