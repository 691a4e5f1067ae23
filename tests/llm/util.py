"""Small tables that hold what operators must bear: nulls, empty and long texts, ties, repeats."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="s", ids=None, extra=False):
    """Documents with the given texts; with ``extra``, columns whose names clash with inner ones."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", source, len(t or "")) for i, t in zip(ids, texts, strict=True)]
    out = spark.createDataFrame(rows, DOCS).coalesce(2)
    if extra:
        names = ["fp", "rep", "h", "id", "key", "spans", "score", "toxic", "size", "rank", "_h", "_toxic", "copies", "below", "fingerprint", "component_id", "ids", "taken"]
        for n in names:
            from pyspark.sql import functions as F

            out = out.withColumn(n, F.lit("x"))
    return out


HARD = [None, "", " \n\t ", "word", "two words", "x" * 5000, "the same text here and there", "the same text here and there", "naïve é ﬁ 😀 text", "a b c " * 3000, "\x00 nul \x00"]
