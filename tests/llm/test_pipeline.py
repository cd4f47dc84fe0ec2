"""The pipeline's stages on a small table."""

import corpus_pipeline
from spindrift.llm.common import DOCUMENT_COLUMNS, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = docs
        if name != "packing":
            assert tuple(docs.columns) == DOCUMENT_COLUMNS
    ids = [r.doc_id for r in seen["near_dedup"].collect()]
    assert len(ids) == len(set(ids)) > 100
    taken = [r.doc_id for r in seen["mixing"].collect()]
    assert set(taken) <= set(ids) and max(map(taken.count, set(taken))) == 2
    assert {r.doc_id for r in seen["packing"].collect()} == set(taken)


def test_stages_on_empty_and_null_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (2, "words of a text that is kept here", "en", None, 33)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, "/nowhere")
            out.collect()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, __node long"


def hard_rows(spark, sf_dir):
    """Documents with repeated rows, rows without an id, a very long text, and further columns whose names clash."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, sf_dir, "documents").collect()]
    long = "\n".join(f"line {i} of a long text with numbers {i * 7} {i * 11} and words" for i in range(3000))
    rows += [rows[3], rows[3], (None, rows[5][1], None, None, None), (None, "words that no other text has here", "en", "a", 33), (10**9, long, "en", None, len(long)), (rows[7][0], "another text of one id, unlike it", "en", "b", 10)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], COLUMNS).repartition(3)


def test_stages_equal_plain_versions(spark, sf_dir):
    from collections import Counter

    from test_methods import bag, brute_lines

    docs = hard_rows(spark, sf_dir)
    plain = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    out = corpus_pipeline.lines(spark, spark.createDataFrame(list(plain.items()), "doc_id long, text string").selectExpr("*", "'en' lang", "'a' source", "0L n_chars"), sf_dir).collect()
    expected = brute_lines(plain)
    assert {r.doc_id: r.text for r in out} == {i: t for i, t in expected.items() if t.split() or t == plain[i]}
    assert all(r.n_chars == (len(r.text) if r.text != plain[r.doc_id] else 0) for r in out)

    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert tuple(kept.columns) == DOCUMENT_COLUMNS
    kept = kept.collect()
    rows = docs.collect()
    bags = [bag(r.text or "") for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            common = sum((a & bags[j]).values())
            if common and 5 * common >= 4 * (sum(a.values()) + sum(bags[j].values()) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    assert len(kept) == len(groups)
    texts = Counter(r.text for r in kept)
    for own in groups.values():
        assert sum(texts[t] for t in {rows[i].text for i in own}) >= 1
    least = {min((rows[i].doc_id for i in own if rows[i].doc_id is not None), default=None) for own in groups.values()}
    assert {r.doc_id for r in kept} == least

    mixed = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix(spark, docs, sf_dir).collect())
    copies = {}
    for r in corpus_pipeline.mixing.mix(docs.select(*DOCUMENT_COLUMNS)).collect():
        copies.setdefault(r.doc_id, Counter())[r["size"]] += r.copies
    by_id = Counter()
    for (i, _), n in mixed.items():
        by_id[i] += n
    assert by_id == Counter({i: sum(c.values()) for i, c in copies.items() if sum(c.values())}) and max(mixed.values()) >= 2

    packed = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.length
    tokens = Counter()
    for r in packed:
        if r.start == 0:
            tokens[r.doc_id] += r.doc_tokens
    assert whole == tokens
