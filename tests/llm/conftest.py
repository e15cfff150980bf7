import pytest

WORDS = "the of and onesen erblest hein inenan eranenes whou therouou thon than heoron eratsh therin blees esheon erstlyat eronthwh reer with anat tisher".split()


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang]) with a null in every column, and extra columns of names used inside."""

    def build(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            for name in ("fp", "key", "kind", "unit", "score", "slot", "spans", "__hits_", "root"):
                df = df.selectExpr("*", f"CAST(NULL AS INT) AS `{name}`")
        return df

    return build


@pytest.fixture(scope="session")
def prose():
    import random

    def text(seed, n=60):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))

    return text
