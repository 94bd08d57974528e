import random

import corpus_pipeline as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm.shared import BATCH_BYTES

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages(spark, tmp_path):
    r = random.Random(8)
    words = [f"word{i}" for i in range(2000)]
    rows, labels = [], []
    for i in range(300):
        text = [r.choice(words) for _ in range(r.randint(20, 80))]
        if i % 10 == 0:
            text[3:5] = ["vile", "dreadful"]
        rows.append([i, " ".join(text), "en", f"s{i % 4}", 0])
        labels.append((i, 1, int(i % 10 == 0)))
    for i in (300, 301):  # near copies of document 1
        near = rows[1][1].split()
        near[0] = f"other{i}"
        rows.append([i, " ".join(near), "en", "s1", 0])
    passage = "\n".join(" ".join(r.choice(words) for _ in range(8)) for _ in range(4))
    rows += [[310 + i, f"{r.choice(words)} start {i}\n{passage}\nend {i} " + " ".join(r.choice(words) for _ in range(40)), "en", "s2", 0] for i in range(3)]
    rows += [[400, None, None, None, None], [401, "", "en", "s0", 0]]
    for row in rows:
        row[4] = None if row[1] is None else len(row[1])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for number, (_, stage) in enumerate(P.STAGES):
        stage(spark, kept[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        kept.append(spark.read.parquet(f"{tmp_path}/{number}"))
        if number < 4:
            assert kept[-1].columns == columns
    ids = [sorted(r["doc_id"] for r in k.select("doc_id").distinct().collect()) for k in kept]
    assert not set(range(0, 300, 10)) & set(ids[1]) and len(ids[1]) == len(rows) - 30
    texts = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    assert passage in texts[310] and passage not in texts[311] and texts[312].endswith(rows[-3][1].split("\n")[-1])
    assert set(ids[2]) - set(ids[3]) == {300, 301}
    whole = {r["doc_id"]: r["doc_tokens"] for r in kept[5].collect()}
    assert set(whole) == set(ids[4])
    assert sum(r["length"] for r in kept[5].collect()) >= sum(whole.values())
    assert P.run(spark, str(tmp_path)).count() > 0 and P.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["toxicity", "n-gram Jaccard join", "packing"])
def test_texts_travel_in_small_batches(spark, tmp_path, name):
    """Stages with Python workers hand them few MB of text at a time, however long the texts:
    the workers' and the JVM's copies of one batch have to fit beside the heap."""
    size = 200_000
    rows = spark.range(0, 80, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), size // 5).alias("text"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    spark.conf.unset(ARROW_BYTES)
    try:
        dict(P.STAGES)[name](spark, docs, str(tmp_path))
        seen = docs.coalesce(1).mapInArrow(measure, "rows long, bytes long").collect()
    finally:
        spark.conf.unset(ARROW_BYTES)
    assert sum(r["rows"] for r in seen) == 80
    assert max(r["bytes"] for r in seen) <= BATCH_BYTES + size + 4096
