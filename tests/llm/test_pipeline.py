import random

import corpus_pipeline
from tabsplit.shared import written


def test_stages_keep_what_they_should(spark, documents, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(25)) for _ in range(n))
    clean = [(k, text(rng.randint(2, 5)), rng.choice("pq")) for k in range(60)]
    exact = [(100 + k, clean[k][1], "p") for k in range(5)]
    near = [(200 + k, clean[10 + k][1].replace("\n", " ", 1) + " closing", "q") for k in range(5)]
    short = [(300, "too short", "p"), (301, None, "p")]
    path = f"{tmp_path}/sf"
    documents(clean + exact + near + short, extra=False).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, path), "stage")
        ids[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert ids["quality rules"] == sorted(d for d, *_ in clean + exact + near)
    assert set(range(60)) <= set(ids["line dedup"]) and not set(range(100, 105)) & set(ids["line dedup"])
    assert len(ids["MinHash near-dedup"]) == len(set(ids["MinHash near-dedup"])) and set(range(60)) <= set(ids["MinHash near-dedup"])
    # on whole texts one of each group stays
    whole = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{path}/documents.parquet"), path).select("doc_id").collect()}
    assert set(range(60)) <= whole and not whole & ({100 + k for k in range(5)} | {200 + k for k in range(5)})
    assert docs.where("decoded <> text").count() == 0 and set(corpus_pipeline.COLUMNS) <= set(docs.columns)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").collect()) == ids["SentencePiece"]


def test_odd_rows_extra_columns_and_no_rows(spark, documents, odd_rows, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows = odd_rows + [(500 + k, " ".join(word() for _ in range(60)), None if k % 7 == 0 else "s") for k in range(40)]
    rows += [rows[-1], rows[-2], (None, rows[-3][1])]
    names = ["n_words", "found", "group", "n", "_copies", "places", "row", "kept", "node"]
    from pyspark.sql import functions as F

    path = f"{tmp_path}/odd"
    documents(rows).withColumns({c: F.lit(7) for c in names}).write.parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.run(spark, path).collect()
    texts = {d: t for d, t, *_ in rows}
    assert out and all(r.decoded == r.text for r in out)
    assert {r.doc_id for r in out} >= {500 + k for k in range(37)} and not {r.doc_id for r in out} & {1, 2, 3}
    assert all(r.text == texts[r.doc_id] for r in out if r.doc_id and r.doc_id >= 500)
    documents(rows).where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
