import corpus_pipeline
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, pii, simhash, toxicity
from ridgeline.llm.common import table

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == docs.columns
        before, kept = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, after))
        if name == "toxicity":
            scored = toxicity.classify(docs, table(spark, SF, "labels"))
            assert set(kept) == {r["doc_id"] for r in scored.collect() if not r["predicted"]}
        elif name == "simhash_near_duplicates":
            assert set(kept) == {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
        elif name == "decontamination":
            dirty = {r["doc_id"] for r in decontaminate.overlaps(docs, table(spark, SF, "benchmark")).collect()}
            assert set(kept) == set(before) - dirty
        else:
            assert set(kept) == set(before) and not any(pii.base_spans(t or "") for t in kept.values())
        docs = after
    rows = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in rows.collect()} == set(kept)


def test_near_duplicates_of_rows_that_share_ids(spark, docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (9, b), (None, c), (None, c), (None, a), (7, None), (8, ""), *((i, f"only {i}") for i in (20, 21))]
    out = corpus_pipeline.drop_near_duplicates(spark, docs(*rows), SF)
    assert out.columns == docs((1, a)).columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect()), key=str) == sorted([(0, c), (1, a), (20, "only 20"), (21, "only 21"), (5, b), (7, None)], key=str)
    twice = table(spark, SF, "documents")
    copies = twice.union(twice.limit(5)).union(twice.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(r[0] for r in corpus_pipeline.drop_near_duplicates(spark, copies, SF).select("doc_id").collect()) == sorted(r[0] for r in corpus_pipeline.drop_near_duplicates(spark, twice, SF).select("doc_id").collect())


def test_pipeline_of_odd_tables(spark, docs, tmp_path):
    """Nulls, empty texts and clashing names; then no rows at all."""
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    for i, rows in enumerate((ODD, [])):
        made = docs(*rows) if rows else docs((1, "a")).limit(0)
        made.withColumn("tokens", F.lit("kept")).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = corpus_pipeline.run(spark, str(tmp_path))
        # null id, empty and one-word texts are components of their own; ids 1 to 3 hold no words, the repeated row stays once
        assert sorted(r["doc_id"] or 0 for r in out.where("piece = 0").collect()) == ([0, 1, 4, 5, 6, 7] if rows else [])
        after = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, after, str(tmp_path))
            assert after.columns == docs((1, "a")).columns and dict(after.dtypes)["score"] == "string"
            assert after.where("score <> 'x' OR tokens <> 'kept'").count() == 0
