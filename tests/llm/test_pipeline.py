"""The stages one by one on a small table, and the whole."""

import itertools
import re

import corpus_pipeline
from metaweave.llm import packing, queries, toxicity


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1)} if words else set()


def one_of_each(docs):
    """The smallest id of every class of texts that similarity 0.8 connects, by all pairs."""
    sets = {r.doc_id: shingles(r.text) for r in docs}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if len(a & b) >= 0.8 * len(a | b):
            x, y = root(i), root(j)
            least[max(x, y)] = min(x, y)
    return {root(i) for i in sets}


def uncontaminated(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    wins = [(min(10, len(w)), w) for w in (words(r.text) for r in items) if w]
    bad = {n: set().union(*(runs(w, n) for m, w in wins if m == n)) for n in {n for n, _ in wins}}
    return {r.doc_id for r in docs if not any(runs(words(r.text), n) & held for n, held in bad.items())}


def test_stages_and_run(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels, benchmark = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("labels", "benchmark"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.join(docs, columns, "left_anti").count() == 0
        ids = {r.doc_id for r in kept.collect()}
        if name == "toxicity":
            model = toxicity.train(docs, labels)
            embed = toxicity.Embedder(model.table)
            cut = lambda r: model.thresholds.get(r.lang, model.thresholds.get("", 0.5))
            assert ids == {r.doc_id for r in docs.collect() if model.score(embed(toxicity.words_of((r.text or "").encode()))) < cut(r)}
        if name == "simhash":
            assert ids == one_of_each(docs.collect())
        if name == "decontaminate":
            assert ids == uncontaminated(docs.collect(), benchmark.collect())
        if name == "exact_dedup":
            norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
            assert len(norm) == len(set(norm))
            first = {}
            for r in docs.collect():
                key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
                first[key] = min(first.get(key, r.doc_id), r.doc_id)
            assert {r.doc_id for r in kept.collect()} == set(first.values())
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    encode = packing.WordEncoder(packing.vocabulary())
    rows = docs.collect()
    coded = {r.doc_id: len(x) // 4 + 1 for r, x in zip(rows, encode([(r.text or "").encode() for r in rows]))}
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == coded
    lengths = [r.length for r in packed.collect()]
    used = packed.select("sequence_id").distinct().count()
    assert used == packing.sweeps({n: lengths.count(n) for n in set(lengths)})[1]
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_stages_on_empty_and_odd_tables(spark):
    sf = "/root/testdata/sf0.001"
    shape = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, "word " * 30, None, "s", 150)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, shape)
        for name in ("toxic", "score", "digest", "node", "threshold"):  # columns that stages use inside
            docs = docs.withColumn(name, docs["doc_id"])
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, sf)
            assert kept.columns == docs.columns and kept.count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(rows)


def test_each_operator_has_one_query():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1
