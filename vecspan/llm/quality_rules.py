"""Quality rules: text statistics and zstandard compression bands.

Three ratios (bytes / compressed bytes) are judged: that of the whole document against the band of its length, those of its
fixed-size chunks against the chunk band, and the growth from chunks to whole, which has a least value by length. High
ratios are repetition, low ones are dense encodings. Growth tells encodings over a small alphabet (hexadecimal, digits,
random letters) from language: both gain from entropy coding, but only language gains from length, as it repeats its
words. The limits lie between clean prose in four languages and encodings of random bytes (base64, base32,
hexadecimal, digits, random words), by length: least growth 1.10 at 1 KB (prose 1.12 and more, encodings up to 1.095), 1.18 at 4 KB
(prose 1.28, encodings 1.13). Below 1,024 bytes there is no growth to measure, and hexadecimal compresses like prose there:
the bands tell only denser encodings (base64) and repetition.

Edge cases: a null or empty text has no words, fails the base rules and is not kept; a text shorter than a chunk has no chunk
rule; a rest behind the last full chunk is judged as the text's last chunk_bytes bytes; a repeated row is judged each time; an empty table
gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from vecspan.llm.common import encoded, id_text, map_batches, slices, table

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """whole: (from this many bytes, least ratio, most ratio, least growth), ascending; a text takes the last entry it reaches."""

    level: int = 3
    whole: tuple[tuple[int, float, float, float], ...] = (
        (0, 0.0, 2.5, 0.0), (256, 1.15, 3.0, 0.0), (512, 1.35, 3.2, 0.0), (1024, 1.35, 3.6, 1.10), (1536, 1.35, 3.8, 1.12), (2048, 1.4, 4.0, 1.15), (4096, 1.45, 5.0, 1.18), (16384, 1.5, 8.0, 1.2),
    )
    chunk_bytes: int = 512
    chunk_least: float = 1.25
    chunk_most: float = 6.0
    chunk_share: float = 0.3


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of width words found at least twice in the text, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(code.__getitem__, words), np.uint64, len(words))
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[j : j + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, width)
    at = np.flatnonzero(same)
    if (windows[order[at]] == windows[order[at + 1]]).all():
        hit = np.zeros(n + 1, bool)
        hit[order[at]] = True
        hit[order[at + 1]] = True
    else:  # a hash collision: count the windows themselves
        seen: dict[bytes, int] = {}
        keys = [windows[i].tobytes() for i in range(n)]
        for k in keys:
            seen[k] = seen.get(k, 0) + 1
        hit = np.array([seen[k] > 1 for k in keys] + [False])
    starts = np.flatnonzero(hit)
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_figures(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    chars = len(raw.decode("utf-8", "replace")) - sum(map(raw.count, (SPACES[i : i + 1] for i in range(6))))
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def in_bands(raw: bytes, press: zstandard.ZstdCompressor, bands: Bands) -> tuple[bool, float, float, float]:
    """Whether the text passes, its whole ratio, the share of its chunks outside the chunk band, and its growth (0: under
    two chunks)."""
    if not raw:
        return False, 0.0, 0.0, 0.0
    ratio = len(raw) / len(press.compress(raw))
    _, least, most, growing = next(x for x in reversed(bands.whole) if len(raw) >= x[0])
    size, growth, share = bands.chunk_bytes, 0.0, 0.0
    if len(raw) >= size:
        full = [len(press.compress(raw[at : at + size])) for at in range(0, len(raw) - size + 1, size)]
        ends = full + [len(press.compress(raw[-size:]))] if len(raw) % size else full
        share = sum(not bands.chunk_least <= size / x <= bands.chunk_most for x in ends) / len(ends)
        growth = ratio * sum(full) / (len(full) * size) if len(full) > 1 else 0.0
    ok = least <= ratio <= most and share <= bands.chunk_share and (len(raw) < 2 * size or growth >= growing)
    return ok, ratio, share, growth


def judge(raw: bytes, press: zstandard.ZstdCompressor, bands: Bands) -> tuple:
    n, chars, symbols, dup, repeat = base_figures(raw)
    failed = n < 20 or 100 * repeat > 30 * n
    ok, ratio, share, growth = in_bands(raw, press, bands)
    return n, chars, symbols, dup, repeat, failed, ok and not failed, ratio, share, growth


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double, growth double"
TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row of figures and verdicts per row of docs (doc_id, text); no exchange."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=bands.level)
        rows = [judge(raw, press, bands) for raw in encoded(batch.column("text"))]
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), TYPES)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], NAMES)

    return map_batches(id_text(docs), f, SCHEMA)


def keep_quality(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, all columns unchanged; no exchange."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in slices(batches, text_col):
            mask = [judge(raw, press, bands)[6] for raw in encoded(batch.column(text_col))]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
