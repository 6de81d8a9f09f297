import corpus_pipeline as pipe
from folioflow.llm import decontam, ngramjoin

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.cache()]
    for name, stage in pipe.STAGES:
        out = stage(spark, seen[-1], SF)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        seen.append(out.cache())
    clean, unique, fresh, masked, packed = seen[1:]
    component = ngramjoin.components(clean).collect()
    assert {r.doc_id for r in unique.collect()} == {r.component_id for r in component}
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in decontam.brute_force([(r.doc_id, r.text) for r in unique.collect()], bench) if r[4]}
    assert {r.doc_id for r in fresh.collect()} == {r.doc_id for r in unique.collect()} - bad
    assert masked.filter("n_chars != length(text)").count() == 0
    assert {r.doc_id for r in masked.collect()} == {r.doc_id for r in packed.select("doc_id").collect()}


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, pii string, n_words int, predicted int, cid long, _n long"


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empties, a very long text, ties, repeats and names that operators use; each stage on its own."""
    base = " ".join(f"w{i % 97}x{i % 89}" for i in range(400))
    bench = " ".join(f"bench{i}" for i in range(30))
    rows = [(i, t, None, None, None, None, None, i, None, None, 7) for i, t in enumerate([base, base + " more", None, "", "   ", bench + " tail", "call +1 (702) 555-0742", "word " * 700_000, base])]
    rows += [rows[0], (None, base, "en", "s", 1, 0.5, "p", 1, 1, 1, 1), (None, None, None, None, None, None, None, None, None, None, None), (0, "other text of a repeated id here", "", "", 0, 0.0, "", 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in pipe.STAGES:
            out = stage(spark, table, str(tmp_path))
            got = out.collect()
            if name != "packing":
                assert out.dtypes == table.dtypes
            if table is not docs:
                assert not got
            elif name == "ngram_jaccard_join":
                assert sorted(str(r.doc_id) for r in got) == ["0", "0", "2", "3", "4", "5", "6", "7", "None", "None"]
            elif name == "benchmark_decontamination":
                assert len(got) == len(rows) - 1 and all(r.doc_id != 5 for r in got)
            elif name == "pii":
                assert len(got) == len(rows) and {r.text for r in got if r.doc_id == 6} == {"call [PHONE]"}
                assert all(r.n_chars == len(r.text) for r in got) and sorted(str(r.pii) for r in got) == sorted(str(r[6]) for r in rows)
            elif name == "packing":
                assert len({r.doc_id for r in got}) == 10
