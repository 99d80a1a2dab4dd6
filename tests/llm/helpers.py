"""Documents with what goes wrong: nulls, empty and long texts, repeated rows, clashing names."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, score double, node bigint, `__text` string"


def odd_documents(spark, texts=()):
    rows = [(None, "null id", "en", "s", 7), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n ", "en", "s", 5), (4, "...!!! ???", "en", "s", 10), (5, "word " * 40_000, "en", "s", 200_000), (6, "same text here", "en", "s", 14), (6, "same text here", "en", "s", 14)]
    rows += [(100 + i, x, "en", f"s{i % 3}", len(x)) for i, x in enumerate(texts)]
    return spark.createDataFrame([(*r, "x", 0.5, 1, "y") for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def keys(rows, name="doc_id"):
    return sorted((x[name] for x in rows), key=lambda v: (v is None, v))


ODD_IDS = [1, 2, 3, 4, 5, 6, 6, None]
