import json

import pytest
from pyspark.sql import functions as F

from sparktext.operators.classify import NaiveBayes, best
from sparktext.plans import cli
from sparktext.sources import loaders
from sparktext.sources.store import SegmentStore, load_vectors, save_vectors, upserted
from sparktext.streaming import incremental


def test_files(spark, tmp_path):
    (tmp_path / "sub" / ".hidden").mkdir(parents=True)
    for name, text in {"a.txt": "alpha", "sub/b.MD": "---\ntitle: \"The B\"\ncategory: x\ntags: [p, q]\n---\nbody", "sub/c.markdown": "# Head line\ntext", "sub/.hidden/d.txt": "no", "e.bin": "no"}.items():
        (tmp_path / name).write_text(text)
    assert {r.id: r.fields["title"] for r in loaders.text_directory(spark, str(tmp_path)).collect()} == {"a.txt": "a", "sub/b.MD": "b", "sub/c.markdown": "c"}
    md = {r.id: r for r in loaders.markdown_directory(spark, str(tmp_path)).collect()}
    assert md["sub/b.MD"].fields == {"title": "The B", "category": "x", "tags": "p, q", "source": "sub/b.MD"} and md["sub/b.MD"].category == "x" and md["sub/b.MD"].text == "body"
    assert md["sub/c.markdown"].fields["title"] == "Head line"
    with pytest.raises(ValueError):
        loaders.within(str(tmp_path), "../x")
    assert cli.main(["search", str(tmp_path), "alpha"], spark)[0].startswith("1\ta.txt")


def test_json_and_judgements(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"id": "1", "text": "t", "tags": ["a", "b"], "n": 3}]))
    r = loaders.json_documents(spark, str(tmp_path / "d.json")).first()
    assert (r.id, r.text, r.fields) == ("1", "t", {"tags": "a, b", "n": "3"})
    (tmp_path / "bad.json").write_text(json.dumps([{"id": "1", "text": "t"}, {"id": "2"}]))
    with pytest.raises(Exception, match="no text in entry 1"):
        loaders.json_documents(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "q.tsv").write_text("# comment\nq1\td1\t2\nq1\td2\t0\n")
    assert {tuple(r) for r in loaders.qrels(spark, str(tmp_path / "q.tsv")).collect()} == {("q1", "d1", 2.0), ("q1", "d2", 0.0)}
    run = spark.createDataFrame([("q1", "d1", 2.0, 1), ("q1", "d2", 1.5, 2)], "query_id string, doc_id string, score double, rank int")
    loaders.as_text(run).coalesce(1).write.text(str(tmp_path / "golden"))
    assert {tuple(r) for r in loaders.from_text(spark, str(tmp_path / "golden")).collect()} == {("q1", "d1", 2.0, 1), ("q1", "d2", 1.5, 2)}
    loaders.write_model(str(tmp_path / "m.json"), {"a": 1})
    assert loaders.read_model(str(tmp_path / "m.json")) == {"a": 1}


def test_store(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue dog"), (3, "red dog")], "doc_id long, text string")
    store.add(docs)
    assert store.documents().count() == 3 and store.info()["segments"] == 0
    store.commit()
    store.add(spark.createDataFrame([(2, "green cat")], "doc_id long, text string"))
    store.remove(spark.createDataFrame([(3,)], "doc_id long"))
    want = {(1, "red fox"), (2, "green cat")}
    assert {tuple(r) for r in store.documents().collect()} == want
    store.commit()
    again = SegmentStore(spark, str(tmp_path / "store"))
    assert {tuple(r) for r in again.documents().collect()} == want and again.should_merge()
    assert {(r.term, r.doc_id) for r in again.postings().collect()} == {("red", 1), ("fox", 1), ("green", 2), ("cat", 2)}
    again.merge()
    assert again.info() == {"segments": 1, "documents": 2, "pending": 0, "sequence": 3} and not again.should_merge()
    assert cli.main(["store", str(tmp_path / "store"), "search", "fox"], spark)[0].startswith("1\t")


def test_vector_signature(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    save_vectors(v, str(tmp_path / "v"), "model-a")
    assert load_vectors(spark, str(tmp_path / "v"), "model-a").count() == 1
    with pytest.raises(ValueError):
        load_vectors(spark, str(tmp_path / "v"), "model-b")
    new = spark.createDataFrame([(1, [2.0]), (2, [3.0])], "id long, v array<double>")
    assert upserted(v, new, "id").count() == 2


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(6)], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    store = SegmentStore(spark, str(tmp_path / "store"))
    incremental.index_stream(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.documents().count() == 6 and store.info()["pending"] == 0
    counts = incremental.class_counts(stream.withColumn("category", F.lit("c")))
    counts.writeStream.format("memory").queryName("class_counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("class_counts").where("term = 'common'").first().c == 6


def test_prequential(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], ["ab"[i % 2] * 3, "x"]) for i in range(12)], "doc_id long, category string, terms array<string>")
    parts = [rows.where(F.col("doc_id").between(a, a + 3)) for a in (0, 4, 8)]
    out = incremental.prequential(parts, NaiveBayes.train, lambda m, d: best(m.predict(d)))
    assert [(i, n, a) for i, n, a in out] == [(1, 4, 1.0), (2, 4, 1.0)]
