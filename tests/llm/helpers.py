"""Small tables that hold the awkward cases."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key long, spans string"
LONG = " ".join(f"word{i % 997} tail{i}" for i in range(30_000))


def docs(spark, texts, sources=None):
    """Documents with extra columns whose names clash with the operators' helpers; a text may come with its own id."""
    rows = []
    for i, t in enumerate(texts):
        doc, text = t if isinstance(t, tuple) else (i, t)
        rows.append((doc, text, "en", sources[i] if sources else f"s{i % 3}", len(text or ""), "x", 1, "y"))
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [None, "", " \n\t", "a", "A a A", "the same line\nand one more\nand a third", "the same line\nand one more\nand a third", LONG, "é ß ñ", (3, "a"), (None, "no id")]
