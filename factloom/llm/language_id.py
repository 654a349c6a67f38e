"""Language ID by rank-order profiles: out-of-place distance of a text's most frequent n-grams to each language's.

Learning counts the words of all labelled texts on the executors, turns them into n-gram counts and sums these by
language; the top ranks of each language make its profile. The profiles (languages x ``profile_size`` ranks) are the
only thing that reaches the driver. n-grams lie inside words padded with one blank on either side and are known by a
64-bit hash each; a worker numbers those it has met, so that a text's counts are one array.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing was learned.
Rows with a null language teach nothing. Ties of counts go by the n-gram's hash, ties of distance by the language's
name, so reruns agree. With a single learned language the score is 1. Repeated rows are judged each for itself. Given a
``furthest``, ``identify`` calls a text ``und`` that is farther than that from every profile; texts of a few words have
too few n-grams to be told from noise, and may stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.storage import table

WORDS = re.compile(r"[^\W\d_]+")
N_MAX = 4
PROFILE_SIZE = 300
UNKNOWN = "und"
#: Share of the largest distance beyond which a text is in no learned language. Documents held out at sf0.01 have 0.68 at most,
#: pieces of 3 to 400 of their words 0.64; random letters 0.78 at least from 10 words on, Hungarian and Finnish 0.76 to 0.78.
FURTHEST = 0.74
#: Words whose n-grams a Python worker remembers.
CACHE = 600_000
#: Distinct words that a learning task holds before it passes their counts on.
HELD = 400_000
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _grams(words: list[str], n_max: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words' n-grams, word after word, and how many each word has. The lone blank is no n-gram."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(chars)) - (ends - size)[word]
    count = [size - 2] + [np.maximum(size - n + 1, 0) for n in range(2, n_max + 1)]
    total = sum(count)
    base = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.int64)
    hashed = np.zeros(len(chars), np.uint64)
    for n in range(1, n_max + 1):
        if n > 1:
            hashed = hashed[:-1]
        hashed = hashed + (chars[n - 1 :] + np.uint64(n)) * np.uint64(_MULTIPLIERS[n - 1])
        mixed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(_MULTIPLIERS[-1])
        mixed = (mixed ^ (mixed >> np.uint64(29))).view(np.int64)
        here, place = word[: len(hashed)], at[: len(hashed)] - (n == 1)
        fits = np.flatnonzero((place >= 0) & (place < count[n - 1][here]))
        out[base[here[fits]] + place[fits]] = mixed[fits]
        base = base + count[n - 1]
    return out, total


class _Words(dict):
    """Numbers for words, and for their n-grams in the order met; those of new words are worked out together."""

    def __init__(self, n_max: int):
        super().__init__()
        self.n_max, self.new = n_max, []
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.hashes = np.empty(0, np.int64)  # of the n-grams by number
        self.sorted, self.number = np.empty(0, np.int64), np.empty(0, np.int32)  # the same in order, and their numbers

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        found, back = np.unique(hashes, return_inverse=True)
        at = np.searchsorted(self.sorted, found)
        fresh = np.ones(len(found), bool) if not len(self.sorted) else self.sorted[np.minimum(at, len(self.sorted) - 1)] != found
        if fresh.any():
            number = np.arange(len(self.hashes), len(self.hashes) + int(fresh.sum()), dtype=np.int32)
            self.hashes = np.concatenate([self.hashes, found[fresh]])
            self.sorted, self.number = np.insert(self.sorted, at[fresh], found[fresh]), np.insert(self.number, at[fresh], number)
            at = np.searchsorted(self.sorted, found)
        return self.number[at][back]

    def learn(self) -> None:
        if self.new:
            new, self.new = self.new, []
            flat, size = _grams(new, self.n_max)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.flat, self.size = np.concatenate([self.flat, self._numbers(flat)]), np.concatenate([self.size, size])

    def grams(self, words: list[str]) -> np.ndarray:
        """Numbers of all n-grams of the words in a row, repeats included."""
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.learn()
        n = self.size[codes]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[codes] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _letters(counts: Counter[str]) -> Counter[str]:
    return Counter({w: n for w, n in counts.items() if w.isalpha() or any(map(str.isalpha, w))})


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", n_max: int = N_MAX, profile_size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """Profiles: for each language its most frequent n-grams (as hashes), most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[str]] = {}

        def grams() -> Iterator[pa.RecordBatch]:
            for name, words in held.items():
                words = _letters(words)
                if words:
                    flat, size = _grams(list(words), n_max)
                    used, back = np.unique(flat, return_inverse=True)
                    sums = np.bincount(back, np.repeat(np.fromiter(words.values(), np.int64, len(words)), size)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(sums)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(name, Counter()).update(WORDS.findall(t.lower()))
            if sum(map(len, held.values())) > HELD:
                yield from grams()
        yield from grams()

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("gram")]
    rank = F.row_number().over(W.partitionBy("lang", F.pmod("gram", F.lit(64))).orderBy(*order))  # the best of a language are among the best of its parts
    best = sums.withColumn("r", rank).where(F.col("r") <= profile_size).drop("r")
    best = best.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("r") <= profile_size)
    profiles: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "r").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class _Judge:
    def __init__(self, profiles: dict[str, list[int]], n_max: int, size: int, furthest: float | None = None, cache: int = CACHE):
        self.langs, self.n_max, self.size, self.furthest, self.cache = sorted(profiles), n_max, size, furthest, cache
        self.listed = np.unique(np.concatenate([np.array(x, np.int64) for x in profiles.values()])) if profiles else np.empty(0, np.int64)
        self.listed_ranks = np.full((len(self.listed) + 1, len(self.langs)), -1, np.int32)  # the last row for all other n-grams
        for j, name in enumerate(self.langs):
            self.listed_ranks[np.searchsorted(self.listed, np.array(profiles[name], np.int64)), j] = np.arange(len(profiles[name]))
        self.forget()

    def forget(self) -> None:
        self.words = _Words(self.n_max)
        self.ranks = np.empty((0, len(self.langs)), np.int32)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [[w for w in WORDS.findall(t.lower()) if w.isalpha() or any(map(str.isalpha, w))] if t and self.langs else [] for t in texts]
        if len(self.words) > self.cache:
            self.forget()
        for words in found:  # numbers first, so that all new words of the texts are worked out at once
            for _ in map(self.words.__getitem__, words):
                pass
        self.words.learn()
        new = self.words.hashes[len(self.ranks) :]
        at = np.searchsorted(self.listed, new)
        at[self.listed[np.minimum(at, len(self.listed) - 1)] != new] = len(self.listed) if len(self.listed) else 0
        self.ranks = np.concatenate([self.ranks, self.listed_ranks[at]])
        judged = [self.judge(self.words.grams(words)) if words else (UNKNOWN, 0.0) for words in found]
        return [x for x, _ in judged], [x for _, x in judged]

    def judge(self, grams: np.ndarray) -> tuple[str, float]:
        if 8 * len(grams) < len(self.ranks):
            keys, sums = np.unique(grams, return_counts=True)
        else:
            sums = np.bincount(grams, minlength=len(self.ranks))
            keys = np.flatnonzero(sums)
            sums = sums[keys]
        if len(sums) > self.size:  # the best, with all that tie with the last of them
            good = np.flatnonzero(sums >= np.partition(sums, -self.size)[-self.size])
            sums, keys = sums[good], keys[good]
        keys = keys[np.lexsort((self.words.hashes[keys], -sums))[: self.size]]
        ranks = self.ranks[keys]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(keys), dtype=np.int32)[:, None])).sum(0)
        best = int(np.argmin(far))
        if self.furthest is not None and far[best] > self.furthest * self.size * len(keys):
            return UNKNOWN, 0.0
        if len(far) == 1:
            return self.langs[0], 1.0
        second = float(np.partition(far, 1)[1])
        return self.langs[best], second / (second + float(far[best])) if second else 0.5


def identify(docs: DataFrame, profiles: dict[str, list[int]], *, text: str = "text", n_max: int = N_MAX, profile_size: int = PROFILE_SIZE, furthest: float | None = None, cache: int = CACHE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0.5 to 1 for a language: the runner-up's share of the two best distances).

    ``furthest``: texts beyond this share of the largest distance to every profile are ``und``. ``cache``: words whose n-grams a worker remembers; fewer take less memory and more time.
    """
    given = docs.select("*", F.col(text).alias("_t"))
    keep = [f for f in given.schema.fields if f.name != "_t" and f.name not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", lang_pred string, score double"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = _Judge(profiles, n_max, profile_size, furthest, cache)
        for batch in batches:
            for k in range(0, len(batch), 256):
                b = batch.slice(k, 256)
                names, scores = j(b.column("_t").to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(f.name for f in keep), "lang_pred", "score"])

    return given.select(*(f.name for f in keep), "_t").mapInArrow(judge, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that take no part in learning: crc32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    profiles = learn(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
