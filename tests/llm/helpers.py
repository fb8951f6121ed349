"""Small tables and brute-force versions for the corpus operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """``rows`` of (doc_id, text[, source[, lang]]); with ``extra``, columns whose names clash with inner ones."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for name in ("size", "node", "key", "rid", "owner", "score", "shard", "host", "__row", "target", "u", "g"):
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit("x"))
    return df


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
