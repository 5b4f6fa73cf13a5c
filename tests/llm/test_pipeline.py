import collections
import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from seriesforge.llm import mixing
from seriesforge.llm.common import written
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        docs = written(stage(spark, docs, SF), name)
        if name != "bpe":
            assert docs.columns == columns
    before, good, distinct, cut, mixed = seen
    assert 0.7 * before.count() < good.count() < before.count()
    texts = lambda frame: [(r.doc_id, r.text) for r in frame.collect()]
    groups = brute.jaccard_components(texts(good))
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(i for i, (_, c) in groups.items() if c == i)
    want = {i: (t, r) for (i, t), r in zip(texts(distinct), brute.substring_dedup(texts(distinct)).values())}
    want = {i: r[2] if r[1] else t for i, (t, r) in want.items() if not r[1] or r[1] < r[0]}
    assert dict(texts(cut)) == want
    assert {r.doc_id for r in mixed.collect()} <= set(want)
    most = mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert most <= 2 and mixed.count() > cut.count()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts_of = dict(texts(mixed))
    rows = docs.collect()
    assert len(rows) == mixed.count()
    for r in rows[:40]:
        ids = library.encode(texts_of[r.doc_id] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_pipeline_keeps_odd_rows_and_empty_tables(spark, tmp_path):
    rows = [(None, "no id here at all", "en", None, 3), (1, None, None, "a", None), (1, "", "en", "a", 0), (2, "some words", None, None, 10), (2, "some words", None, None, 10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (frame, frame.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), "odd")
        assert docs.count() <= 6


def test_mixed_words_come_to_their_sources_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 500), "en", rng.choices(["a", "hot", "c", None], [2, 4, 2, 3])[0], 0) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    target = {r.source: r.target for r in mixing.mix(docs, (3, 1, 2), 1.5).collect()}
    n_words = {i: text.count("w") for i, text, *_ in rows}
    got, times = collections.Counter(), collections.Counter()
    for r in corpus_pipeline.mixed(spark, docs, SF).collect():
        got[r.source] += n_words[r.doc_id]
        times[r.doc_id] += 1
    assert max(times.values()) <= 2
    for s, t in target.items():
        assert abs(got[s] - t) <= 0.02 * t
    again = collections.Counter(r.doc_id for r in corpus_pipeline.mixed(spark, docs.repartition(7), SF).collect())
    assert again == times


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in names if k.startswith("op")}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_texts_are_cut_once(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, f"{text} more", "en", "a", len(text) + 5)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.cut(spark, docs, SF)
    # A second pass of Python in one stage is a second worker for each task, which then stays.
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, text), (2, "more")]
