"""Best-fit packing of tokenised documents into fixed-length sequences.

Best-two-fit on counts of lengths: open a sequence with the longest piece left, fill it greedily with the longest that
fits, then replace its smallest piece by two unpacked ones if they fill the expanded gap more tightly. A packing depends
on lengths alone, and there are at most capacity of them, so the plan is made on the driver from a histogram of at most
2048 rows, whole runs of equal sequences at a time. Pieces then take their places by rank within their length; ranks come
from small salted groups of a length plus prefix sums, so a length that most pieces share is spread over many tasks.

Edge cases: null or empty text is the end token alone; repeated rows are documents of their own; a null doc_id is packed
like any other; texts longer than the capacity are cut into full pieces, the last may be shorter; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspan.llm.common import Stash, id_text, parallel, slices, table

CAPACITY = 2048
#: Word pieces kept per worker; the memory of ids by word is emptied beyond this.
MEMO = 1_000_000

_tokenizers: dict[str, tuple] = {}

# What a tokenizer must declare for its ids to be those of the parts of a text between spaces.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _load(path: str) -> tuple:
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise NotImplementedError("ids are packed as the machine's 32-bit integers, which must be little-endian")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        said = json.loads(tokenizer.to_str())
        by_parts = said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == PRE_TOKENIZER and not any(c.isspace() or x["lstrip"] or x["rstrip"] for x in said["added_tokens"] for c in x["content"])
        last = None
        if by_parts:
            last = np.zeros(tokenizer.get_vocab_size(), bool)  # ids that end a word
            last[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        _tokenizers[path] = (tokenizer, last, {"": b""})
    return _tokenizers[path]


MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _core(part: str) -> tuple[str, str]:
    """A part as (core, mark) whose ids concatenate to those of the part: the vocabulary's normaliser lower-cases
    letters anyway (here only those whose case is a matter of one character), and marks after letters are a word of their own."""
    core = part.rstrip(MARKS)
    if core.isascii():
        return (core.lower(), part[len(core) :]) if core.isalpha() else (part, "")
    if core.isalpha() and core.lower().isalpha():
        return core.lower() if max(core) <= "\xff" else core, part[len(core) :]
    return part, ""


def _encode(new: list[str], tokenizer, last: np.ndarray, memo: dict[str, bytes]) -> None:
    """Ids of new parts into memo. Parts of letters alone are one word each, which its last id tells: they go as one text."""
    plain = [x for x in new if x.isalpha() and (x.isascii() or x.lower().isalpha() and is_normalized("NFC", x))]
    if plain and last.any():
        ids = np.array(tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(last[ids]) + 1)).tolist()
        if len(ends) == len(plain):
            raw = ids.tobytes()
            memo.update((x, raw[a:b]) for x, a, b in zip(plain, [0, *ends], ends))
            new = [x for x in new if x not in memo]
    for x, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
        memo[x] = array("I", e.ids).tobytes()


def token_bytes(text: str, path: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers.

    A pre-tokenizer like PRE_TOKENIZER drops white space and never joins across it, and NORMALIZER has no effect
    across a space, so ids of the parts between spaces concatenate to the ids of the text; parts repeat, so each is
    encoded once. A tokenizer that declares anything else gets whole texts.
    """
    tokenizer, last, memo = _load(path)
    if last is None:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    got = list(map(memo.get, parts))
    if None in got:
        if len(memo) > MEMO:
            memo.clear()
            memo[""] = b""
        forms = {x: _core(x) for x in dict.fromkeys(parts) if x not in memo}
        new = [x for x in dict.fromkeys(y for form in forms.values() for y in form) if x not in memo]
        _encode(new, tokenizer, last, memo)
        for x, (core, mark) in forms.items():
            memo[x] = memo[core] + memo[mark]
        got = map(memo.__getitem__, parts)
    return b"".join(got)


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, with keep_ids) of every piece; no exchange."""
    path = tokenizer_path or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = token_bytes(text or "", path) + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return id_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(piece lengths of a sequence in descending order, number of such sequences)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[list[int], int]] = []
    index = np.arange(capacity + 1)
    while left.any():
        held = left.copy()
        first = int(np.flatnonzero(held)[-1])
        held[first] -= 1
        bin_, gap = [first], capacity - first
        while gap > 0:
            fit = np.flatnonzero(held[: gap + 1])
            if not len(fit):
                break
            length = int(fit[-1])
            take = min(int(held[length]), gap // length)
            bin_ += [length] * take
            held[length] -= take
            gap -= take * length
        if gap > 0 and len(bin_) > 1:
            small, room = bin_[-1], gap + bin_[-1]
            below = np.maximum.accumulate(np.where(held > 0, index, 0))  # longest piece left of at most this length
            a = np.flatnonzero(held[: room + 1])
            b = below[room - a]
            short = (a == b) & (held[a] < 2)
            b[short] = below[np.maximum(b[short] - 1, 0)]
            total = np.where(b > 0, a + b, 0)
            if len(total) and total.max() > small:
                best = int(total.argmax())
                bin_ = [*bin_[:-1], int(a[best]), int(b[best])]
        bin_.sort(reverse=True)
        used = np.bincount(bin_, minlength=capacity + 1)
        kinds = np.flatnonzero(used)
        times = int((left[kinds] // used[kinds]).min())
        left[kinds] -= times * used[kinds]
        out.append((bin_, times))
    return out


def places(patterns: list[tuple[list[int], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of ranks by (length, first rank): first sequence, pieces of the length per sequence, offset of the first."""
    rows, taken, sequence = [], [0] * (capacity + 1), 0
    for bin_, times in patterns:
        at = 0
        for length in dict.fromkeys(bin_):
            uses = bin_.count(length)
            rows.append((length, taken[length], sequence, uses, at))
            taken[length] += times * uses
            at += uses * length
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "uses", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def pack(pieces_df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces() plus sequence_id and offset."""
    spark = pieces_df.sparkSession
    stash = Stash(spark)
    cut = stash.cut(pieces_df, "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    spans = spark.sparkContext.broadcast(places(plan(counts, capacity), capacity))
    n = sum(counts.values())
    group = max(32, n // (4 * parallel(spark)))  # pieces of one length that are ranked together
    salts = F.array(*[F.lit(max(1, -(-counts.get(x, 0) // group))) for x in range(1, capacity + 1)])  # by length
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.element_at(salts, F.col("length").cast("int"))).cast("int")
    salted = cut.withColumn("salt", salt)
    own = W.partitionBy("length", "salt")
    groups = stash.cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "groups")
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if len(counts) + 5 * parallel(spark) < 500_000:  # as many groups at most
        offsets = F.broadcast(offsets)
    ranked = salted.withColumn("rank", F.row_number().over(own.orderBy("doc_id", "piece", "start", "ids_crc32")) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.select(*pieces_df.columns, (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = spans.value
        key = p["length"] << 44 | p["rank"]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            inside = rank - p["rank"][at]
            uses = p["uses"][at]
            made = [pa.array(p["sequence"][at] + inside // uses), pa.array(p["offset"][at] + inside % uses * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in pieces_df.dtypes) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, capacity, keep_ids=keep_ids), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
