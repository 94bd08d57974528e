import pytest
from pyspark.sql import functions as F

from quarry.functions import scoring as S

ROWS = [
    (4001, 1224.43, 1000, 10, 234, 6.28021, 0.0283709393),
    (4001, 1224.43, 1000, 0, 234, 0.0, 0.0),
    (564000, 3389721.837, 12000000, 1, 133987, 0.670684, 1.19775e-7),
]


@pytest.mark.parametrize("n,avg,length,tf,df,bm25,tfidf", ROWS)
def test_published_values(spark, n, avg, length, tf, df, bm25, tfidf):
    idf = S.idf(F.lit(n), F.lit(df))
    args = (F.lit(tf), F.lit(length), F.lit(avg), idf)
    row = spark.range(1).select(S.bm25(*args).alias("a"), S.tf_idf(*args).alias("b")).first()
    assert row["a"] == pytest.approx(bm25, abs=1e-5)
    assert row["b"] == pytest.approx(tfidf, abs=1e-5)


def test_zero_lengths_do_not_fail(spark):
    args = (F.lit(0), F.lit(0), F.lit(0.0), F.lit(1.0))
    row = spark.range(1).select(S.bm25(*args).alias("a"), S.tf_idf(*args).alias("b")).first()
    assert row["a"] == row["b"] == 0.0


def test_unknown_scoring():
    with pytest.raises(ValueError):
        S.resolve("pagerank")
