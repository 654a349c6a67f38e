"""Token-id files: canonical, length-limited Huffman coding of ids.

Three passes over the ids, each a Spark job: the tokenizer's output is written once; ids are counted over all of it and
the counts (at most one row an id of the vocabulary) give one code; then the documents, range-partitioned by id and
sorted, are packed into blocks. A block holds whole documents and decodes by itself. Its bit offsets at every
``STRIDE`` ids are its checkpoints, so a decoder runs all strides of a block side by side with one table look-up an id.

The format is a folder with two Parquet tables, so that any store Spark writes to can hold it:
``codebook`` (id, length) and ``blocks`` (part, block, ids_before, n_ids, doc_ids, n_tokens, checkpoints, bits).
Codes are canonical: shorter lengths first, ids ascending within a length, most significant bit first. ``bits`` is the
concatenation of the codes, ``checkpoints`` little-endian uint32 bit offsets, ``ids_before`` counts within the part;
parts are in document order.

Edge cases: a null or empty text has the end id alone. A null id sorts first. Rows with the same id keep a row each,
ordered by their tokens. An empty table gives empty tables. Other columns are not written.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import Scratch, table

END_ID = 0
MAX_LENGTH = 16
STRIDE = 128
BLOCK = 1 << 18
#: Pieces that a Python worker remembers the ids of.
CACHE = 1_000_000

# Letters, digits and white space of ASCII and Latin-1, as the byte-level pre-tokenizer's pattern classes them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t\n\r "
_PIECES = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\t\n\r -~¡-¬®-ÿ]")
_PLAIN = re.compile(f" [{_L}]+")


class _Codes(dict):
    """Numbers for pieces; a new one is noted as missing."""

    def __init__(self) -> None:
        super().__init__()
        self.missing: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.missing.append(piece)
        return n


class Encoder:
    """The tokenizers library, asked once for each distinct piece of text.

    A byte-level tokenizer never merges across the pieces that its pattern splits off, so a text's ids are its pieces'
    ids in a row. Texts with characters beyond Latin-1, or with a special token, and all texts of other kinds of
    tokenizers go to the library whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        known = json.loads(spec)
        pre = known.get("pre_tokenizer") or {}
        self.by_piece = known["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not known.get("normalizer") and not known.get("truncation")
        special = [x["content"] for x in known.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.size = self.tok.get_vocab_size()
        self.width = np.zeros(self.size, np.int64)
        for token, i in self.tok.get_vocab().items():
            self.width[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.codes, self.flat, self.start, self.length = _Codes(), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Ids of the missing pieces. Those of a blank and letters split again the same way when put in a row."""
        missing, self.codes.missing = self.codes.missing, []
        ids: list[np.ndarray | None] = [None] * len(missing)
        plain = [i for i, p in enumerate(missing) if _PLAIN.fullmatch(p)]
        for k in range(0, len(plain), 2000):
            part = [missing[i] for i in plain[k : k + 2000]]
            got = self.whole(["".join(part)])[0]
            ends = np.searchsorted(np.cumsum(self.width[got]), np.cumsum([len(p.encode()) for p in part])) + 1
            for i, x in zip(plain[k : k + 2000], np.split(got, ends[:-1]), strict=True):
                ids[i] = x
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.whole([missing[i] for i in rest]), strict=True):
            ids[i] = x
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.flat = np.concatenate([self.flat, *ids])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_piece:
            return self.whole(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        easy = [i for i, t in enumerate(texts) if not _OTHER.search(t) and not (self.special and self.special.search(t))]
        hard = sorted(set(range(len(texts))) - set(easy))
        for i, x in zip(hard, self.whole([texts[i] for i in hard]), strict=True):
            out[i] = x
        if len(self.codes) > CACHE:
            self.clear()
        pieces = [_PIECES.findall(texts[i]) for i in easy]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(pieces)), np.int64, int(counts.sum()))
        if self.codes.missing:
            self._learn()
        n = self.length[codes]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[codes] - ends + n, n) + np.arange(int(n.sum()))]
        cuts = np.concatenate(([0], ends))[np.cumsum(counts)]
        for i, x in zip(easy, np.split(ids, cuts[:-1]), strict=True) if easy else ():
            out[i] = x
        return out


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


def tokenize(docs: DataFrame, spec: str, *, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): ids as little-endian bytes, two an id if the vocabulary allows, else four; the end id is added."""
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        dtype = id_type(enc.size)
        end = np.array([end_id], dtype).tobytes()
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.slice(k, 512)
                ids = enc([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(dtype).tobytes() + end for x in ids], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def code_lengths(counts: np.ndarray, longest: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); an id without count has length 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    row, marks = leaf, [np.ones(len(leaf), bool)]
    for _ in range(longest - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, packages])
        at = np.argsort(both, kind="stable")
        row = both[at]
        marks.append(at < len(leaf))
    take = 2 * len(leaf) - 2
    for mark in reversed(marks):
        n = int(mark[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the canonical code with these lengths."""
    codes = np.zeros(len(lengths), np.int64)
    order = [i for i in np.lexsort((np.arange(len(lengths)), lengths)) if lengths[i]]
    code = last = 0
    for i in order:
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[bytes, bytes]:
    """bits, checkpoints."""
    n = lengths[ids]
    at = np.cumsum(n) - n
    if not len(ids):
        return b"", b""
    value = codes[ids].astype(np.uint64) << (64 - (at & 31) - n).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[first]] |= np.bitwise_or.reduceat(value >> np.uint64(32), first)
    words[word[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
    size = -(-int(at[-1] + n[-1]) // 8)
    return words.astype(">u4").tobytes()[:size], at[::stride].astype("<u4").tobytes()


class Decoder:
    def __init__(self, lengths: np.ndarray):
        codes, self.longest = canonical(lengths), int(lengths.max(initial=1))
        self.symbol, self.width = np.zeros(1 << self.longest, np.int32), np.zeros(1 << self.longest, np.int64)
        used = np.flatnonzero(lengths)
        used = used[np.argsort(codes[used] << (self.longest - lengths[used]), kind="stable")]
        reps = 1 << (self.longest - lengths[used])
        self.symbol[: reps.sum()], self.width[: reps.sum()] = np.repeat(used, reps), np.repeat(lengths[used], reps)

    def __call__(self, bits: bytes, checkpoints: bytes, n: int, stride: int = STRIDE) -> np.ndarray:
        b = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        out = np.empty((stride, len(at)), np.int32)
        mask, most, top = (1 << self.longest) - 1, len(window) - 1, 32 - self.longest
        for k in range(stride):
            code = (window[np.minimum(at >> 3, most)] >> (top - (at & 7)).astype(np.uint32)) & mask
            out[k] = self.symbol[code]
            at += self.width[code]
        return out.T.reshape(-1)[:n]


def write(ids: DataFrame, path: str, vocabulary: int, *, longest: int = MAX_LENGTH, block: int = BLOCK) -> None:
    """Files for ids(doc_id, ids), a table that can be read twice."""
    spark, dtype = ids.sparkSession, id_type(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(vocabulary, np.int64)
        for b in batches:
            flat = [np.frombuffer(x.as_buffer(), dtype) for x in b.column(0)]
            sums += np.bincount(np.concatenate(flat), minlength=vocabulary) if flat else 0
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for i, n in ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
    lengths = code_lengths(counts, longest)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used, pa.int32()), "length": pa.array(lengths[used], pa.int32())}), "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    sent = spark.sparkContext.broadcast((canonical(lengths), lengths))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = sent.value
        part, made, before, held = TaskContext.get().partitionId(), 0, 0, 0
        docs: list[object] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, before, held
            flat = np.concatenate(parts)
            bits, checkpoints = pack(flat, codes, lengths)
            row = [pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([docs], pa.list_(kind)), pa.array([list(map(len, parts))], pa.list_(pa.int64())), pa.array([checkpoints], pa.binary()), pa.array([bits], pa.binary())]
            made, before, held = made + 1, before + held, 0
            docs.clear(), parts.clear()
            return pa.RecordBatch.from_arrays(row, ["part", "block", "ids_before", "n_ids", "doc_ids", "n_tokens", "checkpoints", "bits"])

        for b in batches:
            kind = b.column(0).type
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = np.frombuffer(x.as_buffer(), dtype)
                docs.append(d), parts.append(got)
                held += len(got)
                if held >= block:
                    yield flush()
        if docs:
            yield flush()

    kind_sql = ids.schema["doc_id"].dataType.simpleString()
    schema = f"part int, block int, ids_before long, n_ids long, doc_ids array<{kind_sql}>, n_tokens array<long>, checkpoints binary, bits binary"
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>) of the files, by decoding their blocks."""
    return _read(spark, path, "ids array<int>", lambda docs: pa.array(docs, pa.list_(pa.int32())))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files, by decoding their blocks."""
    return _read(spark, path, "ids_crc32 long", lambda docs: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in docs], pa.int64()))


def _read(spark: SparkSession, path: str, column: str, make) -> DataFrame:
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most a row an id of the vocabulary
    stored = spark.read.parquet(f"{path}/blocks")
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.int64)
    for r in book:
        lengths[r["id"]] = r["length"]
    starts, total = {}, 0
    for p, n in stored.groupBy("part").agg(F.sum("n_ids")).orderBy("part").collect():  # one row a part
        starts[p], total = total, total + n
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(lengths)
        for b in batches:
            for r in range(len(b)):
                row = b.slice(r, 1)
                get = lambda c: row.column(c)[0].as_py()  # noqa: B023, E731
                n = row.column("n_tokens").flatten().to_numpy(zero_copy_only=False)
                flat = decode(get("bits"), get("checkpoints"), get("n_ids"))
                first = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([row.column("doc_ids").flatten(), pa.array(starts[get("part")] + get("ids_before") + first), pa.array(n), make(np.split(flat, first[1:]))], ["doc_id", "start", "n_tokens", column.split()[0]])

    return stored.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, {column}")


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def roundtrip(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Tokenizes with the tokenizer file, writes the files to ``path`` (default: the shared folder) and returns their checksums."""
    with open(tokenizer, encoding="utf-8") as f:  # a parameter of the job, sent to the executors by the driver
        spec = f.read()
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    ids = scratch.save(tokenize(docs, spec), "ids")
    path = path or f"{scratch.root}/files"
    write(ids, path, encoder(spec).size)
    scratch.drop("ids")
    return checksums(spark, path)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(table(spark, sf_dir, "documents"), vocabulary_file())
