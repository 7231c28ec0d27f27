"""The pipeline on small tables: each stage keeps what it should."""

import corpus_pipeline
from tidewave.llm import decontamination, langid, ngram_join
from tidewave.llm.common import materialize, table


def test_stages(spark, sf):
    docs, sizes = table(spark, sf, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), f"test-{name}")
        sizes.append(docs.count())
        assert docs.columns == (columns if name != "mix" else [*columns, "copies"])
        if name == "near_duplicates":
            assert ngram_join.join(docs).where("doc_id <> component_id").count() == 0
            first = ngram_join.join(before).where("doc_id = component_id").select("doc_id")
            assert {r[0] for r in first.collect()} == {r[0] for r in docs.select("doc_id").collect()}
        if name == "decontaminate":
            assert decontamination.search(docs, table(spark, sf, "benchmark")).count() == 0
        if name == "language":
            kept = langid.identify(before).where("lang_pred <> 'und' and score >= 0.5").count()
            assert kept == docs.count()
        if name == "redact":
            assert before.count() == docs.count() and docs.where("text like '%<EMAIL>%'").count() > 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


def test_empty(spark, tmp_path, sf):
    docs = table(spark, sf, "documents").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_columns(spark, sf):
    """Nulls, empty and long texts, ties, repeated rows, and further columns whose names need quotes or clash."""
    base = [r for r in table(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    rows = [(*r, f"x{i}", i, "row", {"k": 1}, i % 2) for i, r in enumerate(base)]
    tail = ("y", 1, "z", None, None)
    rows += [(None, None, None, None, None, *tail), (900, "", "en", "web0", 0, *tail), (901, " \n", None, "", 2, *tail), (None, "some words of no id at all here", "en", "web1", 30, *tail)]
    rows += [rows[3], rows[3], (902, "a word " * 60_000, "en", None, 420_000, *tail), (903, base[5]["text"], base[5]["lang"], "other", 1, *tail)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, __id long, copies string, `class` map<string, int>, `further5` int"
    docs = spark.createDataFrame(rows, shape).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), f"odd-{name}")
        assert docs.columns == (before.columns if name != "mix" else [*before.columns, "_copies"])
        assert docs.schema["a.b"].dataType == before.schema["a.b"].dataType and 0 < docs.count() <= before.count()
        if name == "language":
            assert docs.where("text is null or trim(text) in ('', '\\n')").count() == 0 and docs.where("doc_id = 902").count() == 1
        if name == "near_duplicates":
            assert docs.groupBy("doc_id").count().where("count > 1").count() == 0 and docs.where("doc_id = 903").count() == 0
            given = {r[5]: tuple(r) for r in rows}
            assert all(str(given[r["a.b"]][:4]) == str((r["doc_id"], r["text"], r["lang"], r["source"])) for r in docs.collect() if r["a.b"].startswith("x"))
