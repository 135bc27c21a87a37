from pyspark.sql import functions as F

from metaweave.llm import toxicity


def test_every_labelled_row_is_learned_from(spark):
    """Label 1 comes only after the first 6,000 labelled rows in the order of their hashes."""
    ids = spark.range(9000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"), toxicity.fold("id", 4).alias("f")).collect()
    train = sorted((r.h, r.doc_id) for r in ids if r.f != 2)
    assert len(train) > 6400
    late = {d for _, d in train[6000:]}
    bad = {d for d in late if d % 2} | {r.doc_id for r in ids if r.f == 2 and r.doc_id % 3 == 0}
    docs = spark.createDataFrame([(r.doc_id, f"the {r.doc_id % 17} day was " + ("scum" if r.doc_id in bad else "fine") + " again", "en") for r in ids], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r.doc_id, int(r.doc_id in bad)) for r in ids], "doc_id bigint, toxic int")
    assert toxicity.labelled(docs, labels).count() == len(train)
    got = toxicity.predict(docs, labels).where("held_out").collect()
    assert sum(r.toxic == (r.doc_id in bad) for r in got) > 0.99 * len(got)
