"""The pipeline against brute force, the SQL of the operators that have it, and removal of the subpackage."""

import os
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from vecspan.llm import decontaminate, packing, quality_rules, registry

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def fixture_rows():
    rng = np.random.default_rng(11)

    syllables = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "s")]
    vocabulary = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(3000)]
    weights = 1 / np.arange(2, 3002)

    def text(n):
        return " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))

    rows = [(k, f"{text(120)}\nfooter of the site\n{text(60)}", "en", "a" if k % 3 else "b") for k in range(60)]
    items = [(k, f"{text(20).capitalize()}. {text(8).capitalize()}.") for k in range(6)]
    for k in range(6):  # exact copies, near copies, leaks
        rows.append((100 + k, rows[k][1], "en", "b"))
        w = rows[10 + k][1].split(" ")
        w[50] = "changed"
        rows.append((200 + k, " ".join(w), "en", rows[10 + k][3]))
        rows.append((300 + k, f"{text(80)} {items[k][1]} {text(90)}", "en", "c"))
    rows += [(400, "spam spam " * 900, "en", "a"), (401, None, "en", "a"), (402, "", None, None), (403, "too short", "en", None), (None, text(150), "en", None), (404, text(9000), "en", None)]
    return rows, items


def brute(rows, items):
    press = zstandard.ZstdCompressor(level=3)
    kept = [r for r in rows if quality_rules.judge((r[1] or "").encode(), press, quality_rules.Bands())[6]]
    pages = Counter(r[3] for r in kept)
    lines = Counter((r[3], x) for r in kept for x in set(r[1].split("\n")) if x.split())
    drop = {k for k, n in lines.items() if k[0] is not None and n >= 3 and n > 0.1 * pages[k[0]]}
    kept = [(i, "\n".join(x for x in t.split("\n") if (s, x) not in drop), lang, s) for i, t, lang, s in kept]

    def grams(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, out = [], []
    for r in sorted((r for r in kept if r[0] is not None), key=lambda r: r[0]):
        g = grams(r[1])
        if not any(len(g & s) / len(g | s) >= 0.8 for s in sets):
            out.append(r)
        sets.append(g)
    out += [r for r in kept if r[0] is None]
    clean = []
    for r in out:
        words = decontaminate.normal_words(r[1])
        held = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        hit = False
        for _, t in items:
            q, a = decontaminate.question_answer(t)
            need = decontaminate.shingles(q, 5)
            hit = hit or (len(need & held) >= 0.8 * len(need) and set(a) <= set(words))
        if not hit:
            clean.append(r)
    return clean


def test_pipeline(spark, tmp_path):
    rows, items = fixture_rows()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = brute(rows, items)
    ids = sorted({str(r.doc_id) for r in out})
    assert ids == sorted({str(r[0]) for r in clean})
    assert not {"100", "200", "300", "400", "401", "403"} & set(ids) and {"0", "10", "404", "None"} <= set(ids)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t, _, _ in clean:
        b = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(str(i), k, zlib.crc32(b[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(b), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in out) == sorted(want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    rows, items = fixture_rows()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(*r, 1, "own") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, f0 string").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    order = [got.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[k] for k in order)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


def test_every_operator_has_its_query():
    names = list(registry.QUERIES)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"


def test_the_rest_works_without_the_subpackage(tmp_path):
    for name in ("vecspan", "tests", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "vecspan/llm"), str(tmp_path / "tests/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_euclidean' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q if n[2:3].isdigit())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
    tests = ["tests/test_catalog.py", "-k", "known or binarize or l2_norm", "-q", "-x"]
    subprocess.run([sys.executable, "-m", "pytest", *tests], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
