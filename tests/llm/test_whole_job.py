"""Cases in which an operator once did less than the whole job."""

import os
import subprocess
import sys
import time
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from spindrift.llm import common, line_dedup, lm_scoring, vector_dedup


def test_lm_scores_do_not_depend_on_the_words_broadcast(spark):
    rows = [(i, " ".join(f"common{j % 3} w{i % 7} rare{i * 5 + j}" for j in range(5))) for i in range(40)] + [(100, "common0 rare7 rare8 unseen"), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, few, none = ({r.doc_id: r for r in lm_scoring.lm_scores(docs, F.col("doc_id") >= 100, most=n).collect()} for n in (1 << 19, 20, 0))
    for got in (few, none):
        for doc_id, r in whole.items():
            assert got[doc_id].score == pytest.approx(r.score, rel=1e-9) and got[doc_id].base_score == pytest.approx(r.base_score, rel=1e-9)
            assert got[doc_id].n_known == r.n_known


def test_lm_is_fitted_on_every_training_window(spark):
    rows = [(i, " ".join(f"w{(i * 31 + j * 17) % 997}" for j in range(10_000))) for i in range(40)] + [(40, None), (41, ""), (42, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gathered = common.pinned(lm_scoring.gather(docs, lm_scoring.vocabulary_path()))
    counts = {r.key: r.n for r in gathered.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    found = lm_scoring.training_windows(gathered).collect()
    n, met = np.zeros(len(lm_scoring.SHARES)), np.zeros(lm_scoring.SYMBOLS, np.int64)
    for r in found:
        symbols, lengths = lm_scoring.unpack_windows(r.ids, r.n)
        assert len(lengths) == r.n and len(symbols) == lengths.sum() and 0 < lengths.min() and lengths.max() <= lm_scoring.WINDOW
        met += np.bincount(symbols, minlength=lm_scoring.SYMBOLS)
        n[r["round"]] += r.n
    assert n.sum() > 20_000 and {i: c for i, c in enumerate(met.tolist()) if c} == counts
    assert np.abs(n / n.sum() - np.array(lm_scoring.SHARES) / 64).max() < 0.02
    # What a worker trains on is all it is given.
    batches = [pa.RecordBatch.from_pylist([{"n": r.n, "ids": r.ids}]) for r in found]
    assert sum(len(lengths) for _, lengths in lm_scoring._runs_of_windows(iter(batches))) == n.sum()


def test_lm_workers_hold_spellings_and_windows_in_little_memory():
    speller = lm_scoring.Speller(lm_scoring.vocabulary_path())
    texts = [" ".join(f"w{i * 7919 % 1_000_003}x" for i in range(at, at + 20_000)).encode() for at in range(0, 400_000, 20_000)]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for text in texts:
        speller.spell(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert held < 100 * 400_000
    # A row of half a megabyte takes more than its size of an executor's heap.
    windows = lm_scoring.Windows()
    n = 40_000 * lm_scoring.WINDOW
    windows.add(np.array([1]), np.arange(n) % lm_scoring.SYMBOLS, np.array([0, n]))
    rows = windows.flush()
    assert sum(rows.column("n").to_pylist()) == 40_000 and max(map(len, rows.column("ids").to_pylist())) < 1 << 18


def test_lm_spellings_of_more_words_than_places(monkeypatch):
    monkeypatch.setattr(lm_scoring, "SLOTS", 8)
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", 250)
    speller = lm_scoring.Speller(lm_scoring.vocabulary_path())
    for start in (0, 50, 200, 0, 5_000):
        words = [f"word{i * 37 % 9973}s" for i in range(start, start + 1 + start // 2 + 100)]
        text = " ".join(words * 2).encode()
        _, keys, place, flat, bounds = speller.spell(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert len(keys) == len(words) + 1
        for w, at in zip(words * 2, place):
            ids = speller.encoder.array(" " + w)
            assert flat[bounds[at] : bounds[at + 1]].tolist() == [2 * i + (j == len(ids) - 1) for j, i in enumerate(ids.tolist())]


def test_neighbours_count_both_sides(spark):
    windows = [np.array([3, 5, 3, 70_001]), np.array([5, 70_001]), np.array([3])]
    packed = lm_scoring.pack_windows(np.concatenate(windows), np.array([len(x) for x in windows]))
    df = spark.createDataFrame([(0, 3, packed)], "round long, n long, ids binary")
    near = lm_scoring.neighbours(df, np.array([5, 70_001]))
    assert near[3].tolist()[:2] == [2, 1] and near[5].tolist()[:2] == [0, 1] and near[70_001].tolist()[:2] == [1, 0]
    assert near.sum() == 5


A, B, C, D = ("one two three four five six", "red green blue black white grey", "sun moon star sky cloud rain", "oak elm ash fir yew box")


def test_rows_without_id_lose_only_their_own_lines(spark):
    texts = [f"{A}\nx", f"{D}\ny\n{B}", f"z\nq\n{A}"]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = sorted((r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect())
    kept = [t for t, n in got if n == 0]
    assert f"{D}\ny\n{B}" in kept and sum(t.count(A) for t, _ in got) == 1 and sum(n for _, n in got) == 1


@pytest.mark.parametrize("doc_id", [None, 4])
def test_copies_in_rows_of_one_id(spark, doc_id):
    near = f"{A} seven eight nine ten"
    docs = spark.createDataFrame([(doc_id, A), (doc_id, A), (doc_id, C), (doc_id, near), (doc_id, f"{near} more"), (9, B)], "doc_id long, text string")
    got = [r.text for r in line_dedup.dedup_lines(docs).collect()]
    assert len(got) == 6 and got.count("") == 2 and {A, C, B} <= set(got) and ({near, f"{near} more"} & set(got))


def test_pipeline_keeps_rows_without_id_and_other_texts_of_an_id(spark):
    rows = [(0, A), (0, A), (0, C), (None, B), (None, D), (5, f"{A}"), (6, "some other text of six words")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted([("0", A), ("0", C), ("None", B), ("None", D), ("6", "some other text of six words")])


def test_arrow_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for before, after in (("256m", common.BATCH_BYTES), ("64MB", common.BATCH_BYTES), ("1024", 1024), ("4k", "4k")):
        spark.conf.set(name, before)
        common.steady(spark)
        assert spark.conf.get(name) in (str(after), f"{after}b")
    spark.conf.unset(name)
    common.steady(spark)
    assert spark.conf.get(name) == str(common.BATCH_BYTES)


def test_no_rows_of_a_tree_in_a_batch():
    tree = vector_dedup.Tree(0, np.eye(4))
    rows, codes = tree.descend(np.zeros((0, 4)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(rows) == len(codes) == 0


def test_near_copies_that_no_split_divides(spark):
    """Splits of near copies multiply them: they are compared as they are, and all links are found."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal(32) + rng.standard_normal((400, 32)) * 0.002
    v = np.vstack([v, rng.standard_normal((100, 32))]).astype(np.float32)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(vectors, leaf_rows=30).collect()}
    assert got == {i: (399, 0) if i < 400 else (0, i) for i in range(500)}


def postings(rng, size):
    p = np.zeros(size, line_dedup._posting(0))
    p["n"] = rng.integers(4, 61, size)
    p["at"] = rng.random(size) * (p["n"] // 5 + 1)
    p["id"] = rng.integers(0, 1 << 62, size, dtype=np.uint64)
    p["sketch"] = rng.integers(0, 1 << 63, (size, 1), dtype=np.uint64)
    return p


def test_long_lists_of_one_word_are_compared_in_little_time():
    p = postings(np.random.default_rng(5), 20_000)
    start = time.process_time()
    line_dedup.nearest_earlier(p, (16, 64), None)
    assert time.process_time() - start < 1.2


def test_all_pairs_of_a_list_within_the_filters():
    rng = np.random.default_rng(6)
    p = postings(rng, 600)
    p["token"] = rng.integers(0, 2, 600)
    p["sketch"] = np.where(rng.random((600, 1)) < 0.7, np.uint64(7) << rng.integers(0, 6, (600, 1)).astype(np.uint64), p["sketch"])
    rows = p.tolist()
    expected = set()
    for x in rows:
        for y in rows:
            both = x[1] + y[1]
            least, far = -(-4 * both // 9), (int(x[4][0]) ^ int(y[4][0])).bit_count()
            fits = 5 * min(x[1], y[1]) >= 4 * max(x[1], y[1]) and min(x[1] - x[2], y[1] - y[2]) >= least
            if x[0] == y[0] and fits and far <= both - 2 * least and x[3] >> 32 > y[3] >> 32:
                expected.add((x[3], y[3], far))
    found = line_dedup.nearest_earlier(p, None, None)
    assert set(zip(*[x.tolist() for x in found[:3]])) == expected and expected


def test_executors_give_their_heap_back(tmp_path):
    """In a session of its own, since only a cluster has executors beside the driver."""
    script = tmp_path / "heap.py"
    script.write_text(HEAP)
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    own = os.environ | {"PYTHONPATH": root, "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_HOME": os.path.dirname(pyspark.__file__), "SPARK_SCALA_VERSION": "2.13"}
    run = subprocess.run([sys.executable, str(script)], env=own, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "heap" in run.stdout, run.stderr[-2000:]
    before, after = map(float, run.stdout.split("heap")[1].split()[:2])
    assert after < 0.7 * before, (before, after)


HEAP = """
import time, psutil
from pyspark.sql import SparkSession
from spindrift.llm.common import tidy
spark = SparkSession.builder.master("local-cluster[1,4,2000]").config("spark.executor.memory", "1800m").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()

def size():
    for p in psutil.Process().children(recursive=True):
        if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()):
            return psutil.Process(p.pid).memory_info().rss / 2**20

spark.range(3000000).selectExpr("id % 1000000 k", "repeat(uuid(), 4) v").groupBy("k").agg({"v": "max"}).write.format("noop").mode("overwrite").save()
before = size()
tidy(spark)
time.sleep(3)  # memory is given back beside the program
print("heap", before, size(), flush=True)
spark.stop()
"""
