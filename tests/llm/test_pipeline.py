import os
import random
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.common import documents, prose
from tests.llm.test_decontaminate import ITEMS, brute as leaks_of
from tests.llm.test_ngram_join import brute as near_of, edited
from tests.llm.test_secret_scan import base as secrets_of

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(i, prose(i, 60 + i % 200), "en", f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, edited(rows[i][1], rng, 1), "en", "s0") for i in range(12)]
    rows += [(300 + i, rows[0][1], "en", "s1") for i in range(5)]
    rows += [(400 + i, prose(4000 + i, 50) + " " + ITEMS[i][1] + " " + prose(5000 + i, 50), "en", "s2") for i in range(6)]
    rows += [(500 + i, prose(6000 + i, 40) + f' token = "{rng.getrandbits(160):040x}" ' + prose(7000 + i, 20), "en", "s3") for i in range(6)]
    rows += [(600, None, "en", "s0"), (601, "", None, None), (602, "12 34 56", "en", "s0"), (None, prose(9000, 80), "en", None), (603, prose(8000, 90), None, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, folder


def test_run_against_brute_force(spark, corpus):
    rows, folder = corpus
    kept = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    near = near_of([(i, t) for i, t, *_ in kept])
    kept = [r for r in kept if r[0] is None or near[r[0]][3] == r[0]]
    leaked = {i for i, _ in leaks_of([(i, t) for i, t, *_ in kept if i is not None], ITEMS)}
    kept = [r for r in kept if r[0] not in leaked]
    assert {400, 401, 402, 403, 404, 405} <= leaked and len(kept) < len(rows) - 20
    sizes = {}
    for i, text, *_ in kept:
        for start, _, end in sorted(secrets_of(text), reverse=True):
            if not any(a < start and end <= b for a, _, b in secrets_of(text)):
                text = text[:start] + "<secret>" + text[end:]
        sizes[i] = len(text.split())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {i: r["size"] for i, r in got.items()} == sizes
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got.values())


def test_stages_keep_the_columns_and_take_effect(spark, corpus):
    _, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.schema.simpleString() == docs.schema.simpleString(), name
    clean = {r["doc_id"]: r for r in after.collect()}
    assert "<secret>" in clean[500]["text"] and clean[500]["n_chars"] == len(clean[500]["text"]) and clean[500]["spans"] == "clash"
    assert clean[1]["text"] == prose(1, 61) and clean[600]["text"] is None
    assert len(corpus_pipeline.STAGES) == 5


def test_rows_with_null_and_repeated_ids_are_judged(spark, tmp_path):
    texts = [prose(100 + i, 80) for i in range(8)]
    leak = f"{prose(1, 40)} {ITEMS[0][1]} {prose(2, 40)}"
    rows = [(None, texts[0]), (None, texts[0] + " more"), (1, texts[0])]  # near copies with and without an id
    rows += [(2, texts[1])] * 3 + [(None, texts[2])] * 2  # identical rows
    rows += [(3, texts[3]), (3, texts[4]), (4, texts[3]), (5, texts[4])]  # one id for two texts, each with a copy
    rows += [(None, leak), (6, texts[5]), (6, leak + " more"), (7, None), (None, texts[6])]
    docs = documents(spark, rows)
    near = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    kept = [(r["doc_id"], r["text"]) for r in near.collect()]
    ids = [(1, texts[0]), (2, texts[1]), (None, texts[2]), (3, texts[3]), (3, texts[4]), (6, texts[5]), (7, None), (None, texts[6])]
    assert near.columns == docs.columns
    assert sorted(map(str, kept)) == sorted(map(str, [*ids, (6, leak + " more")]))
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path))
    left = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert sorted(map(str, left)) == sorted(str(x) for x in rows if not (x[1] or "").startswith(leak))


def test_empty_table(spark, corpus, tmp_path):
    _, folder = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_imports_without_the_operators(tmp_path):
    """The entry module works where the subpackage and the pipeline have been taken out."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
    code = "import __spark_entry__ as e; assert {'pipeline', *e.queries()} == {*e.queries()} and sum(n.startswith('op') for n in e.queries()) == 13"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={**os.environ, "PYTHONPATH": str(ROOT)})
