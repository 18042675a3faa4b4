"""Each stage of the pipeline, and the whole, against plain versions of what it decides."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_hits, brute_lines, shingles
from test_dropout_draws import brute

from fathomline.llm import cotraining, merge_dropout
from fathomline.llm.queries import SEED

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, component_id int"


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words)
    texts = [(1, near), (2, near + " more"), (2, "quite another text under the id two is here to stay"), (3, None), (None, near), (None, None), (4, ""), (5, " ".join(reversed(words))), (5, " ".join(reversed(words))), (6, "short")]
    texts += [(7, "one\ntwo\nthree\nfour"), (8, "zero\none\ntwo\nthree\nend"), (9, "one\ntwo\nthree")]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in texts], SCHEMA)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_stages_keep_columns_and_empty_tables(spark, docs):
    for _, work in corpus_pipeline.STAGES[:-1]:
        assert work(spark, docs, SMALL).columns == docs.columns
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, docs.limit(0), SMALL).count() == 0


def test_quality_keeps_what_the_classifier_takes_for_good(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = cotraining.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = cotraining.score(docs, model).where("p_good >= 0.5").select(*docs.columns)
    assert rows(corpus_pipeline.quality(spark, docs, SMALL)) == rows(want)


def test_line_dedup(spark, docs):
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id")
    cut = brute_lines([(r.doc_id, r.text) for r in known.collect()])
    want = [(i, t) for i, (_, n, t) in cut.items() if not n or t.strip(" ")]
    found = corpus_pipeline.line_dedup(spark, known, SMALL).collect()
    assert sorted((r.doc_id, r.text) for r in found if r.text is not None) == sorted(x for x in want if x[1] is not None)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found) and {r.doc_id for r in found} == {i for i, _ in want}


def test_near_dedup_keeps_one_row_of_each_group(spark, docs):
    found = corpus_pipeline.near_dedup(spark, docs, SMALL)
    have = [(r.doc_id, r.text) for r in found.collect()]
    left = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for i, t in sorted(left, key=lambda r: (r[0] is None, r[0] or 0)):
        own = shingles(t)
        if not own or all(100 * len(own & shingles(u)) < 75 * len(own | shingles(u)) for _, u in want):
            want.append((i, t))
    assert sorted(map(repr, have)) == sorted(map(repr, want)) and (1, left[0][1]) in have


def test_decontamination_drops_rows_by_row(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    bad = spark.createDataFrame([(6, items[0][1], "en", "s", 1, "x", 1), (None, "a " + items[1][1], "en", "s", 1, "x", 1)], SCHEMA)
    both = docs.unionByName(bad)
    want = [r for r in both.collect() if not brute_hits(r.text, items)[1]]
    assert rows(corpus_pipeline.decontamination(spark, both, SMALL)) == sorted(map(repr, map(tuple, want))) == rows(docs)


def test_the_whole_is_its_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL).collect()
    by_hand = docs
    for _, work in corpus_pipeline.STAGES[:-1]:
        by_hand = work(spark, by_hand, SMALL)
    left = by_hand.collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in left} and len(out) == len(left) and all(r.lossless for r in out)
    ids = {r.doc_id: list(r.ids) for r in out}
    short = sorted((r for r in left if len(r.text or "") < 400), key=lambda r: r.doc_id)[:8]
    assert short and all(ids[r.doc_id] == brute(r.text or "", SEED, merge_dropout.text_key(r.doc_id, r.text or "")) for r in short)
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert not any(brute_hits(r.text, items)[1] for r in left)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1 or quality = 0").select(F.col("doc_id"))
    assert by_hand.join(labels, "doc_id").count() < 0.5 * docs.join(labels, "doc_id").count()
