"""Columns of the input that are named like columns an operator adds."""

from pyspark.sql import functions as F

from adtide.llm import jaccard, mixing
from adtide.llm.store import free_names

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_inner_names_of_mixed_and_one_of_each(spark):
    rows = [(k, f"text number {k} " * 3, "en", "abc"[k % 3], k) for k in range(30)]
    plain = spark.createDataFrame(rows, DOCS)
    names = ("_id", "id", "_pattern", "pattern", "_repeats", "repeats", "_copy", "copy", "_turn", "turn")
    clash = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    for operator in (mixing.mixed, jaccard.one_of_each):
        want = sorted(map(tuple, operator(plain).collect()))
        out = operator(clash)
        assert out.columns == clash.columns
        got = sorted(map(tuple, out.collect()))
        assert [r[:5] for r in got] == want
        assert all(v == f"{c}{r[0]}" for r in got for c, v in zip(names, r[5:], strict=True))


def test_free_names(spark):
    assert free_names(spark.createDataFrame([(1, 2)], "Id int, _id int"), "id", "row") == ["__id", "row"]
