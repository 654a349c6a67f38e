"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel counts the common subsequences of three characters of two strings; one stretched over s characters weighs
DECAY**s, and a stretch has at most SPAN characters. So an insult stays close to itself with characters put in or left
out, whatever its language. It is normalised to 1 for equal strings.

Learning (labelled rows, at most about ``sample`` of them, chosen by a hash of their id): a sentence has its document's
label, and is clean if any clean document has it too; the executors count in how many different toxic and clean
sentences each string occurs. Strings that toxic sentences
prefer are the positive examples, frequent and hash-chosen strings of clean sentences the negative ones, both of bounded number.
A share of each are the landmarks; the machine is linear in the Nyström features. Since the kernel is an inner product
over subsequences, the trained machine folds into one weight for each subsequence of the landmarks, and scoring a string is a
look-up. A document's score is a logistic function of its three highest strings, fitted on the same sample.

Strings are the letters and digits of each blank-separated piece of a lower-cased text, between marks for their ends,
and each run of three or more pieces of one or two characters joined ("i d i o t", "mo ro n"). So the machine's examples are the words and
joined runs of labelled sentences; an insult of several longer words, each of them usual, isn't seen. Whole texts are scored.

Edge cases: null and empty texts have no strings and get the score of a text without evidence. Without labels of both
classes every score is 0. Rows with a null label or text teach nothing. Repeated rows are scored each for itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import Scratch, table

SAMPLE = 40_000
EXAMPLES = 3_000
LANDMARKS = 400
PENALTY = 1e-3
#: Highest strings of a document that its score rests on.
TOP = 3
SPAN = 5
DECAY = 0.7
#: Strings that a Python worker remembers the score of.
CACHE = 150_000
#: Strings scored at a time.
CHUNK = 4_000
SHORT = 2  # pieces up to this long are joined with their neighbours of this kind
LONGEST = 64  # a string is scored in overlapping parts of this many characters
_STEPS = [(a, b) for a, b in combinations(range(1, SPAN), 2)]
_SENTENCE = re.compile(r"[.!?\n]+\s*")


def strings(text: str | None) -> list[str]:
    """The text's strings, repeats included."""
    pieces = [p for p in (x if x.isalnum() else "".join(filter(str.isalnum, x)) for x in (text or "").lower().split()) if p]
    out = [p for p in pieces if len(p) > 2]
    if len(pieces) - len(out) > 2:
        run: list[str] = []
        for p in [*pieces, "   "]:
            if len(p) <= SHORT:
                run.append(p)
            elif run:
                if len(run) > 2:
                    out.append("".join(run))
                run = []
    return [y for x in out for y in ([x] if len(x) <= LONGEST else [x[i : i + LONGEST] for i in range(0, len(x) - SPAN, LONGEST - SPAN)])]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence, weight), sorted, each pair once; a word's weights have length 1."""
    words = [f"\x02{w}\x03" for w in words]
    n = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), n)
    ends = np.cumsum(n)[word] if len(words) else word
    at = np.arange(len(chars))
    w, c, v = [], [], []
    for a, b in _STEPS:
        i = np.flatnonzero(at + b < ends)
        w.append(word[i]), c.append(chars[i] << 42 | chars[i + a] << 21 | chars[i + b]), v.append(np.full(len(i), DECAY ** (b + 1)))
    w, c, v = map(np.concatenate, (w, c, v))
    order = np.lexsort((c, w))
    w, c, v = w[order], c[order], v[order]
    if not len(w):
        return w, c, v
    first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (c[1:] != c[:-1]))))
    w, c, v = w[first], c[first], np.add.reduceat(v, first)
    return w, c, v / np.sqrt(np.bincount(w, v * v, len(words)))[w]


class Machine(NamedTuple):
    """subsequence (sorted) -> weight; bias; logistic coefficients of 1 and the highest strings."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    logit: tuple[float, ...] | None

    def __call__(self, words: list[str]) -> np.ndarray:
        w, c, v = features(words)
        k = np.minimum(np.searchsorted(self.codes, c), len(self.codes) - 1)
        hit = self.codes[k] == c
        return np.bincount(w[hit], v[hit] * self.weights[k[hit]], len(words)) + self.bias


def _dense(words: list[str], codes: np.ndarray) -> np.ndarray:
    w, c, v = features(words)
    k = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
    hit = codes[k] == c
    out = np.zeros((len(words), len(codes)))
    out[w[hit], k[hit]] = v[hit]
    return out


def fit_machine(good: dict[str, float], bad: dict[str, float], landmarks: int = LANDMARKS, penalty: float = PENALTY) -> Machine:
    """Squared-hinge machine over Nyström features; both classes are strings with their evidence, most evident first."""
    half = max(1, landmarks // 2)
    marks = [*list(bad)[:half], *list(good)[:: max(1, len(good) // half)][:half]]
    codes = np.unique(features(marks)[1])
    base = _dense(marks, codes)
    values, vectors = np.linalg.eigh(base @ base.T)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    fold = base.T @ root  # subsequences -> Nyström features
    words = [*bad, *good]
    x = np.concatenate([_dense(words[i : i + 500], codes) @ fold for i in range(0, len(words), 500)])
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    y = np.where(np.arange(len(words)) < len(bad), 1.0, -1.0)
    weight = np.concatenate([np.array(list(v.values())) / sum(v.values()) / 2 for v in (bad, good)])
    ridge, w = penalty * np.eye(x.shape[1]), np.zeros(x.shape[1])
    ridge[-1, -1] = 1e-8
    loss = lambda w: weight @ np.maximum(0, 1 - y * (x @ w)) ** 2 + w @ ridge @ w
    for _ in range(100):  # Newton steps over the rows inside the margin, each as long as it lowers the loss
        act = y * (x @ w) < 1
        xa = x[act] * weight[act, None]
        step = np.linalg.solve(xa.T @ x[act] + ridge, xa.T @ y[act] - (xa.T @ x[act] + ridge) @ w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now - 1e-10:
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
    return Machine(codes, fold @ w[:-1], float(w[-1]), None)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _peaks(docs: DataFrame, machine: Machine, column: str) -> DataFrame:
    """``docs`` (id columns and ``_text`` last) with the highest strings' scores, or with their logistic."""
    keep = [f for f in docs.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", {column}"
    logit = machine.logit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in (batch.slice(k, 256) for batch in batches for k in range(0, len(batch), 256)):
            found = [set(strings(t)) for t in b.column("_text").to_pylist()]
            if len(known) > CACHE:
                known.clear()
            new = sorted(set(chain.from_iterable(found)) - known.keys())
            for i in range(0, len(new), CHUNK):
                known.update(zip(new[i : i + CHUNK], machine(new[i : i + CHUNK]).tolist(), strict=True))
            tops = np.full((len(found), TOP), machine.bias)
            for i, words in enumerate(found):
                got = sorted(map(known.__getitem__, words), reverse=True)[:TOP]
                tops[i, : len(got)] = got
            tops = np.clip(tops, -3, 3)
            out = [pa.array(x.copy()) for x in tops.T] if logit is None else [pa.array(1 / (1 + np.exp(-np.clip(logit[0] + tops @ np.array(logit[1:]), -30, 30))))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), *out], [*(f.name for f in keep), *([f"top{k}" for k in range(TOP)] if logit is None else ["score"])])

    return docs.mapInArrow(run, schema)


def learn(rows: DataFrame, *, text: str = "text", label: str = "label", key: str = "doc_id", sample: int = SAMPLE, examples: int = EXAMPLES) -> Machine | None:
    """rows(key, text, label 0/1) -> a machine, or None without both classes."""
    scratch = Scratch(rows.sparkSession, "toxicity")
    rows = rows.select(F.xxhash64(key).alias("h"), F.col(text).alias("_text"), F.col(label).cast("int").alias("label")).where("_text IS NOT NULL AND label IS NOT NULL")
    n = rows.select("label").count()
    if n > sample:
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    rows = scratch.save(rows.select("label", "_text"), "sample")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(y, x) for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in set(_SENTENCE.split(t))]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([x for _, x in found], pa.string())], ["label", "sentence"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[int(y > 0)].update(set(strings(x)))
        words = sorted(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([sums[1][w] for w in words], pa.int64()), pa.array([sums[0][w] for w in words], pa.int64())], ["word", "bad", "good"])

    sentences = rows.mapInArrow(split, "label int, sentence string").groupBy("sentence").agg(F.min("label").alias("label"))
    words = scratch.save(sentences.mapInArrow(count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "words")
    total = words.agg(F.sum("bad"), F.sum("good")).first()
    if not total[0] or not total[1]:
        return None
    ratio = ((F.col("bad") + 0.5) / float(total[0])) / ((F.col("good") + 0.5) / float(total[1]))
    words = words.withColumn("odds", F.log(ratio))
    evidence = F.col("bad") * F.col("odds")
    usual = words.where("good >= 1 AND odds < 1").withColumn("e", F.log1p("good"))
    picks = [words.where("bad >= 2 AND odds > 2").withColumn("e", evidence).orderBy(F.desc("e"), "word"), usual.orderBy(F.desc("e"), "word"), usual.orderBy(F.xxhash64("word"), "word")]
    bad, common, others = ({r["word"]: r["e"] for r in x.limit(examples).collect()} for x in picks)  # at most ``examples`` each
    if not bad or not common:
        return None
    machine = fit_machine(common | others, bad)
    tops = [f"top{k}" for k in range(TOP)]
    seen = _peaks(rows, machine, ", ".join(f"{c} double" for c in tops)).toPandas()  # at most about ``sample`` rows of four numbers
    x = np.column_stack([np.ones(len(seen)), *(seen[c] for c in tops)])
    return machine._replace(logit=tuple(_logistic(x, (seen["label"] > 0).to_numpy(float))))


def score(docs: DataFrame, machine: Machine | None, *, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``score`` between 0 and 1."""
    if machine is None:
        return docs.drop(text, "score").withColumn("score", F.lit(0.0))
    return _peaks(docs.drop("score").withColumn("_text", F.col(text)).drop(text), machine, "score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that take no part in learning: crc32 of the id as text, modulo 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    machine = learn(docs.where(~F.col("held_out")).join(labels, "doc_id"))
    return score(docs, machine).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
