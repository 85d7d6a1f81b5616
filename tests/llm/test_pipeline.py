"""Stages of the corpus pipeline: what goes, what stays, and odd tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from quarry.session import ship  # noqa: E402

#: Names inside the operators.
EXTRA = ("t", "spans", "base", "__spans", "n_words", "c0", "cell", "rest")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with planted cases, written as the tables that the stages read."""
    ship(spark)
    root = str(tmp_path_factory.mktemp("sf"))
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda"
    rows = []
    for i in range(160):
        words = [f"w{(i * 37 + k * k * 13 + k) % 997}" for k in range(80)]
        if i % 4 == 0:
            words[10:40:6] = ["vilek"] * 5
        rows.append((i, " ".join(words)))
    clean = rows[1][1].split()
    rows += [(500, rows[1][1]), (501, " ".join(clean[:-1] + ["changed"])), (502, f"before it {item} behind it " + "x y z " * 20), (503, "my password=abcdef123456 is here"), (506, "one id with this text"), (506, "and another text of the same id"), (507, "q8Zr5TtLx0Vb2Nc7Mk4Jp9Hg" * 4000), (504, ""), (505, None), (None, "no id"), (503, "my password=abcdef123456 is here")]
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.lit(k) for k, c in enumerate(EXTRA)})
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *EXTRA]
        docs.write.parquet(f"{tables}/out-{name}")
        docs = spark.read.parquet(f"{tables}/out-{name}")
        seen[name] = docs
    ids = lambda n: {r.doc_id for r in seen[n].collect()}
    toxic = set(range(0, 160, 4))
    assert len(ids("toxicity") & toxic) <= 2 and len(ids("toxicity") - toxic) >= 120
    assert not {500, 501} & ids("near_dup") and {1, 502, 503, 504, 505, None} <= ids("near_dup") and seen["near_dup"].where("doc_id = 503").count() == 1
    assert seen["near_dup"].where("doc_id = 506").count() == 2 and seen["secrets"].where("doc_id = 507").first().text == "<secret>"
    assert seen["decontamination"].where("text like '%epsilon%'").count() == 0 and 502 in ids("decontamination")
    assert seen["secrets"].where("text like '%abcdef123456%'").count() == 0 and seen["secrets"].count() == seen["decontamination"].count()
    assert ids("packing") == ids("secrets")


def test_empty_table(spark, tables, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, tables)
        assert out.count() == 0, name
        if name != "packing":
            empty = out
