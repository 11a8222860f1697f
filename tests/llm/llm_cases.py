"""Rows that every operator must bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, hash string"


def docs(spark, rows):
    """Documents with odd rows among them: nulls everywhere, empties, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", None) for i, t, s in rows], DOCS)


ODD = [(1, None, None), (2, "", "a"), (2, "", "a"), (None, "one two", "b"), (3, "word " * 30000, "b"), (4, "😀 é", None)]


def clashing(df, *names):
    """df with further columns of names that an operator might use itself."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(f"own {n}") for n in names})
