"""Benchmark decontamination: BM25 with block-max WAND over an index of the test items, queried by every passage.

Index: BM25 impacts of each item's terms, divided by the item's score for its own text, so a passage's score is the
weighted share of the item that it holds. A term's postings lie in item order, in blocks with the largest impact and the
last item of each. Terms found in most items are non-essential: all together they stay below half the threshold for every
item, and count towards the bounds as a rest. The essential lists of a passage are walked with a cursor each: the pivot is the
first item at which the largest impacts of the lists before it reach the threshold, so items before it are never looked
at; if the block maxima at the pivot do not reach it, all cursors pass the nearest block's end unread. Only items whose blocks
reach the threshold are scored, exactly, so all items above the threshold are retrieved. Each is then verified: the share of
the question's five-word shingles in the passage, and of the answer's words (the answer is the item's last sentence; an item of
one sentence is both).

Passages are windows of twice the longest item, one item length apart, so any copy lies wholly inside one. Words are
lower-cased and stripped of marks. The index is broadcast: items are taken in shards of SHARD_BYTES of text, each in its
own pass over the documents, so what is broadcast is bounded whatever the number of items. Document frequencies, mean and
greatest length are those of all items, so scores and windows do not depend on the shards.

Edge cases: null or empty texts and items match nothing; items without words are ignored; repeated items match each
on their own; of passages with equal scores and overlaps the first in the document is reported; repeated documents are reported each
time; a null doc_id is reported as null; texts of any length are taken whole; empty tables give empty results; other columns are
ignored (decontaminate() keeps them).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.llm.common import Stash, encoded, id_text, slices, table

SHARD_BYTES = 16 << 20
MEMO = 400_000
EDGE = re.compile(r"^\W+|\W+$")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Limits:
    score: float = 0.6
    question: float = 0.8
    answer: float = 0.8
    shingle: int = 5
    k1: float = 1.2
    b: float = 0.75
    block: int = 4


def normal(word: str) -> str:
    return EDGE.sub("", word.lower())


def normal_words(text: str) -> list[str]:
    return [x for x in map(normal, text.split()) if x]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    parts = [w for w in map(normal_words, SENTENCE.split(text.strip())) if w]
    if len(parts) < 2:
        return (parts[0], parts[0]) if parts else ([], [])
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(ids: list[int], width: int) -> set[tuple[int, ...]]:
    return {tuple(ids[i : i + width]) for i in range(max(1, len(ids) - width + 1))} if ids else set()


@dataclass(frozen=True)
class Statistics:
    """Of all items with words: their number, mean and greatest number of words, and how many hold each term."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, texts: list[str | None]) -> Statistics:
        words = [w for w in (normal_words(t or "") for t in texts) if w]
        return cls(len(words), sum(map(len, words)) / max(1, len(words)), max(map(len, words), default=0), Counter(t for w in words for t in set(w)))


@dataclass
class Index:
    limits: Limits
    items: list[int] = field(default_factory=list)
    vocab: dict[str, int] = field(default_factory=dict)
    weights: list[dict[int, float]] = field(default_factory=list)
    question: list[set] = field(default_factory=list)
    answer: list[set] = field(default_factory=list)
    stride: int = 32
    seen: Counter = field(default_factory=Counter)  # what wand() met: blocks, opened blocks, pivots, skips

    def build(self, rows: list[tuple[int, str]], stats: Statistics | None = None) -> Index:
        lim = self.limits
        stats = stats or Statistics.of([t for _, t in rows])
        texts = [(i, *question_answer(t or ""), normal_words(t or "")) for i, t in rows]
        texts = [x for x in texts if x[3]]
        for item, q, a, words in texts:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            self.items.append(item)
            self.question.append(shingles([self.vocab[w] for w in q], lim.shingle))
            self.answer.append({self.vocab[w] for w in a})
            self.weights.append(Counter(ids))
        idf = [math.log(1 + (stats.n - stats.df[w] + 0.5) / (stats.df[w] + 0.5)) for w in self.vocab]
        for k, c in enumerate(self.weights):
            norm = lim.k1 * (1 - lim.b + lim.b * sum(c.values()) / stats.mean)
            raw = {t: idf[t] * f * (lim.k1 + 1) / (f + norm) for t, f in c.items()}
            total = sum(raw.values())
            self.weights[k] = {t: x / total for t, x in raw.items()}
        self.stride = max(32, stats.longest)
        self._post(len(self.items))
        return self

    def _post(self, n: int) -> None:
        lim = self.limits
        lists: list[list[tuple[int, float]]] = [[] for _ in self.vocab]  # item order
        for k, c in enumerate(self.weights):
            for t, x in c.items():
                lists[t].append((k, x))
        rest, plain = np.zeros(n), set()
        for t in sorted(range(len(lists)), key=lambda t: (-len(lists[t]), t)):
            if len(lists[t]) < 2:
                break
            more = np.zeros(n)
            for k, x in lists[t]:
                more[k] = x
            if (rest + more).max() <= lim.score / 2:
                rest += more
                plain.add(t)
        self.rest, self.most_rest = rest.tolist(), float(rest.max(initial=0))
        kept = [[] if t in plain else x for t, x in enumerate(lists)]
        self.postings = [[k for k, _ in x] for x in kept]
        cuts = [range(0, len(x), lim.block) for x in kept]
        self.block_last = [[x[min(a + lim.block, len(x)) - 1][0] for a in c] for x, c in zip(kept, cuts)]
        self.block_top = [[max(w for _, w in x[a : a + lim.block]) for a in c] for x, c in zip(kept, cuts)]
        self.top = np.array([max((w for _, w in x), default=0.0) for x in kept] or [0.0])

    def wand(self, terms: list[int]) -> list[int]:
        """Items (their numbers) whose upper bound for a passage with these essential terms reaches the threshold."""
        need, size, seen = self.limits.score - 1e-9, self.limits.block, self.seen
        lists, lasts, tops = self.postings, self.block_last, self.block_top
        most = {t: float(self.top[t]) for t in terms}
        cursors = [(lists[t][0], t, 0) for t in terms]
        seen["blocks"] += sum(len(lasts[t]) for t in terms)
        found, opened = [], set()
        while True:
            cursors.sort()
            bound, pivot = self.most_rest, -1
            for p, c in enumerate(cursors):
                bound += most[c[1]]
                if bound >= need:
                    pivot = p
                    break
            if pivot < 0:
                break
            seen["pivots"] += 1
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, past = self.rest[item], len(self.items)
            for _, t, at in cursors[: pivot + 1]:
                b = bisect_left(lasts[t], item, at // size)
                if b < len(lasts[t]):
                    bound += tops[t][b]
                    past = min(past, lasts[t][b] + 1)
            if bound >= need:
                found.append(item)
                opened.update((t, bisect_left(lasts[t], item, at // size)) for _, t, at in cursors[: pivot + 1])
                past = item + 1
            else:  # nothing before the nearest block's end, or the next list's start, can reach it
                seen["skips"] += 1
                past = max(item + 1, min(past, cursors[pivot + 1][0]) if pivot + 1 < len(cursors) else past)
            moved = cursors[pivot + 1 :]
            for _, t, at in cursors[: pivot + 1]:
                at = bisect_left(lists[t], past, at)
                if at < len(lists[t]):
                    moved.append((lists[t][at], t, at))
            cursors = moved
        seen["opened"] += len(opened)
        return found


class Terms(dict):
    """Term id of a word as it stands in a text; -1: not in the vocabulary, -2: no word. Bounded."""

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        plain = normal(word.decode("utf-8", "replace"))
        got = self.vocab.get(plain, -1) if plain else -2
        self[word] = got
        return got


def search(index: Index, terms: Terms, texts: list[bytes]) -> list[tuple[int, int, int, float, float, float]]:
    """(row of texts, item id, first word, score, question overlap, answer overlap) of the best passage of each match."""
    lim, stride, tops = index.limits, index.stride, index.top
    need = lim.score - 1e-9 - index.most_rest
    best: dict[tuple[int, int], tuple] = {}
    lengths = {len(next(iter(q))) for q in index.question}
    for d, raw in enumerate(texts):
        words = raw.split()
        ids = np.fromiter(map(terms.__getitem__, words), np.int64, len(words))
        ids = ids[ids > -2]
        at = np.flatnonzero(ids >= 0)
        at = at[tops[ids[at]] > 0]
        if not len(at):
            continue
        last = max(0, -(-len(ids) // stride) - 2)  # the last passage
        segment = at // stride
        key = np.unique(np.concatenate((np.minimum(segment, last), np.maximum(segment - 1, 0))) * len(tops) + np.concatenate((ids[at], ids[at])))
        passage, term = np.divmod(key, len(tops))
        edges = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1], [True])))
        reach = np.add.reduceat(tops[term], edges[:-1]) >= need
        for a, b in zip(edges[:-1][reach].tolist(), edges[1:][reach].tolist()):
            found = index.wand(term[a:b].tolist())
            if not found:
                continue
            start = int(passage[a]) * stride
            own = ids[start : start + 2 * stride].tolist()
            present, held = set(own), None
            for k in found:
                score = sum(w for t, w in index.weights[k].items() if t in present)
                if score < lim.score:
                    continue
                held = held if held is not None else {n: shingles(own, n) for n in lengths}
                q = index.question[k]
                q_share = len(q & held[len(next(iter(q)))]) / len(q)
                a_share = len(index.answer[k] & present) / len(index.answer[k])
                if q_share >= lim.question and a_share >= lim.answer:
                    new = (score, q_share, a_share, -start)
                    if (d, k) not in best or new > best[d, k]:
                        best[d, k] = new
    return [(d, index.items[k], -s, round(score, 6), q, a) for (d, k), (score, q, a, s) in sorted(best.items())]


def _statistics(rows: DataFrame) -> tuple[DataFrame, Statistics]:
    """Table of term, n (items that hold it), and the other figures of all items. rows: t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            own = Statistics.of(batch.column("t").to_pylist())
            cols = [[None, *own.df], [own.n, *own.df.values()], [round(own.mean * own.n)] + [0] * len(own.df), [own.longest] + [0] * len(own.df)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.int64(), pa.int64()])], ["term", "n", "words", "longest"])

    found = rows.mapInArrow(run, "term string, n long, words long, longest long").groupBy("term")
    found = Stash(rows.sparkSession).cut(found.agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest")), "terms")
    total = found.where("term is null").first()
    n, words, longest = (total["n"], total["words"], total["longest"]) if total else (0, 0, 0)
    return found.where("term is not null").select("term", "n"), Statistics(n, words / max(1, n), longest, {})


def _indexes(items: DataFrame, limits: Limits, item_col: str, text_col: str) -> Iterator[Index]:
    """An index for each shard of the items."""
    spark = items.sparkSession
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + int(size // SHARD_BYTES)
    df, total = _statistics(rows.select("t"))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        own = sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
        held = df
        if n > 1:  # only the shard's terms come to the driver
            terms = sorted({w for _, t in own for w in normal_words(t or "")})
            held = df.join(spark.createDataFrame([(w,) for w in terms], "term string"), "term", "left_semi")
        yield Index(limits).build(own, Statistics(total.n, total.mean, total.longest, {r["term"]: r["n"] for r in held.collect()}))


SCHEMA = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"


def matches(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per document row and test item it holds, with the best passage; no exchange."""
    spark, out = docs.sparkSession, None
    for index in _indexes(items, limits, item_col, text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            terms = Terms(index.vocab)
            for batch in slices(batches):
                ids = batch.column("doc_id").to_pylist()
                got = search(index, terms, encoded(batch.column("text"))) if index.items else []
                if got:
                    cols = list(zip(*[(ids[d], *x) for d, *x in got]))
                    types = [pa.int64()] * 3 + [pa.float64()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in SCHEMA.split(", ")])

        part = id_text(docs).mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a test item, all columns unchanged; no exchange."""
    spark, out = docs.sparkSession, docs
    for index in _indexes(items, limits, "item_id", "text"):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            terms = Terms(index.vocab)
            for batch in slices(batches, text_col):
                mask = np.ones(batch.num_rows, bool)
                if index.items:
                    for d, *_ in search(index, terms, encoded(batch.column(text_col))):
                        mask[d] = False
                yield batch.filter(pa.array(mask))

        out = out.mapInArrow(run, docs.schema)
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
