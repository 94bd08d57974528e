import pytest

#: Clashing names that operators use inside.
EXTRA = ("n_lines", "_id", "r", "position", "size", "spans", "segs", "score", "leaf", "node", "doc_hash", "g")


@pytest.fixture(scope="session")
def make(spark):
    """Documents (doc_id, text, source) with extra columns of clashing names."""

    def build(rows, extra=True):
        names = ["doc_id", "text", "source", *(EXTRA if extra else ())]
        kinds = ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names)
        full = [(*r, *([None] * (3 - len(r))), *(["x"] * len(EXTRA) if extra else [])) for r in rows]
        return spark.createDataFrame(full, kinds).repartition(3)

    return build
