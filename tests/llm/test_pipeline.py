import re

import corpus_pipeline
from priorframe.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k, n=60):
    return " ".join(f"w{(k * 7919 + i * i) % 997}" for i in range(n))


def test_each_stage_on_planted_rows(spark, tmp_path):
    bench = prose(900, 30)
    clean = {k: prose(k) for k in range(1, 40)}
    texts = dict(clean)
    texts[50], texts[51] = clean[3], clean[3] + "\n" + prose(51)
    texts[60] = prose(60) + " " + bench + " " + prose(61)
    for k in range(100, 160):
        texts[k] = prose(k) + (" foulword dirtyword" * 3 if k % 2 else "")
    texts[200], texts[201] = None, ""
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    marks = [(k, 1, k % 2) for k in range(100, 160)] + [(k, 1, 0) for k in range(1, 20)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert set(seen["toxicity"]) == {k for k in texts if not (100 <= k < 160 and k % 2)}
    assert set(seen["line dedup"]) == set(seen["toxicity"])
    assert seen["line dedup"][50].text == "" and seen["line dedup"][51].text == prose(51)
    assert {50, 200, 201} & set(seen["simhash near-dedup"]) == {50}
    assert set(seen["simhash near-dedup"]) - set(seen["decontamination"]) == {60}
    assert all(r.exact and len(r.ids) == r.n_tokens for r in seen["bpe"].values())
    whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {k: r.n_tokens for k, r in seen["bpe"].items()}


def test_empty_repeated_and_clashing(spark, tmp_path):
    """An empty table goes through; repeated rows and columns of the operators' own names break no stage."""
    spark.createDataFrame([(1, prose(900, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, rows in (("none", []), ("repeated", [(1, prose(1), "en", "s", 9)] * 3 + [(None, prose(2), "en", "s", 9), (2, None, "en", "s", None)])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
        for table in ("benchmark", "labels"):
            spark.read.parquet(f"{tmp_path}/{table}.parquet").write.parquet(f"{at}/{table}.parquet")
        found = corpus_pipeline.run(spark, at).collect()
        assert all(r.exact for r in found) and len([r for r in found if r.doc_id == 1]) == (1 if rows else 0)
    odd = spark.read.parquet(f"{tmp_path}/repeated/documents.parquet").selectExpr("*", "1 as id", "2 as n", "3 as __text_key", "4 as kept", "5 as comp")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, str(tmp_path)).count() > 0


def test_every_operator_has_one_query():
    names = list(queries.QUERIES)
    assert [int(re.match(r"op(\d+)_\w+$", n)[1]) for n in names] == list(range(1, 14))
    assert set(queries.ORACLES) <= set(names)
