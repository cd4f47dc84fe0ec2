"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from spindrift.llm import langid, line_dedup, lm_scoring, mixing, near_dedup, packing, token_counts, toxicity, vector_dedup, vector_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, score string, label string"
WORDS = "der die das und oder nicht the of and is was eine haus garten blume wasser feuer erde luft wind"


def rows():
    long = " ".join(WORDS.split()[i % 20] + str(i % 977) for i in range(60_000))
    extra = (7, "k", "s", "l")
    texts = [None, "", " \n\t ", "one", WORDS, WORDS, WORDS + " more", long, "x" * 300_000, "日本語のテキスト " * 50, "...!!! 123", "line a b c d e\nline a b c d e\nline a b c d e f"]
    out = [(i, t, ["en", "de", None][i % 3], ["a", None, "b"][i % 3], len(t or ""), *extra) for i, t in enumerate(texts)]
    return [*out, out[4], (None, WORDS, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


N = len(rows())


def test_token_counts(docs, none):
    got = {(r.doc_id): r for r in token_counts.token_counts(docs).collect()}
    assert len(got) == N - 1 and got[0].n_tokens == got[1].n_tokens == got[2].n_tokens == 0
    assert got[4].n_words == 20 and got[4].n_tokens >= 20 and got[8].n_words == 1 and got[8].n_tokens > 1
    assert token_counts.token_counts(none).count() == 0


def test_language(docs, none):
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model, ("doc_id",)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 10))
    assert all(got[i].lang_pred in ("en", "de") and 0 < got[i].score <= 1 for i in (3, 4, 7, 8, 9))
    empty = langid.learn(none)
    assert langid.identify(none, empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_lm(docs, none):
    got = lm_scoring.lm_scores(docs, F.lit(False)).collect()
    assert len(got) == N
    by = {r.doc_id: r for r in got}
    assert by[0].n_tokens == by[1].n_tokens == 1 and by[0].score == by[1].score < 0 and by[4].n_known == by[4].n_tokens == 21
    assert lm_scoring.lm_scores(none, F.lit(False)).count() == 0
    nothing = lm_scoring.lm_scores(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in nothing)


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == N and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).collect())
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0


def test_packing(docs, none):
    got = packing.pack(packing.cut_pieces(docs, packing.vocabulary_path())).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert sum(r.length for r in got if r.doc_id == 0) == 1 == sum(r.length for r in got if r.doc_id == 1)
    assert packing.pack(packing.cut_pieces(none, packing.vocabulary_path())).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == N and all(0 <= r.copies <= 2 for r in got) and {r["size"] for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).columns == none.columns
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_lines(docs, none):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == N
    # The null id comes first, so the same line of documents 4 and 5 goes; 6 is 20/21 alike.
    assert by[None].text == WORDS and by[4].text == by[5].text == by[6].text == "" and by[4].n_removed == 1
    assert by[11].text == "line a b c d e" and by[11].n_removed == 2 and by[0].text is None and by[3].text == "one"
    assert line_dedup.dedup_lines(none).count() == 0


def test_near_duplicates(docs, none):
    got = near_dedup.near_duplicates(docs)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == N and by[4].class_id == by[5].class_id == 4 and by[6].class_id == 4 and not by[6].kept
    assert all(by[i].kept for i in (0, 1, 2, 3, 7, 8, 9, 11))
    assert near_dedup.near_duplicates(none).count() == 0


VECS = "vec_id long, embedding array<float>, label int, rep long, leaf long, width int"
NAN, INF = float("nan"), float("inf")


def vectors(spark):
    made = [[1.0, 0.0, 0.5], [1.0, 0.0, 0.5], [2.0, 0.0, 1.0], [0.0, 1.0, 0.0], None, [], [NAN, 1.0, 1.0], [INF, 0.0, 1.0], [0.0, 0.0, 0.0], [None, 1.0, 1.0], [1.0, 0.0], [-1.0, 0.0, -0.5]]
    data = [(i, v, 1, 0, 0, 0) for i, v in enumerate(made)] + [(50, [1.0, 0.0, 0.5], None, 0, 0, 0), (50, [1.0, 0.0, 0.5], 1, 0, 0, 0), (None, [1.0, 1.0, 1.0], 1, 0, 0, 0)]
    return spark.createDataFrame(data, VECS)


def test_vector_search(spark):
    v = vectors(spark)
    got = vector_search.top_k(v, F.col("vec_id") % 50 == 0).collect()
    first = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0)
    assert first[:3] == [(1, 2, 256 * 512 + 128 * 256), (2, 1, 256 * 256 + 128 * 128), (3, 50, 256 * 256 + 128 * 128)]
    assert {r.vec_id for r in got} <= {0, 1, 2, 3, 8, 11, 50}
    assert vector_search.top_k(v.limit(0), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, -1.0]), (2, [-3e38, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vector_search.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_vector_dedup(spark):
    v = vectors(spark)
    got = vector_dedup.near_duplicates(v)
    rows = got.collect()
    assert len(rows) == v.count()
    by = {r.vec_id: r for r in rows if r.vec_id != 50}
    assert by[0].n_links == by[1].n_links == by[2].n_links == 3 and {by[i].component_id for i in (0, 1, 2)} == {0}
    assert all(by[i].n_links == 0 and by[i].kept for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert sorted(r.n_links for r in rows if r.vec_id == 50) == [0, 3]
    assert vector_dedup.near_duplicates(v.limit(0)).count() == 0
