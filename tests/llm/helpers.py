"""Small tables with the awkward rows that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, ids=None, schema=DOCS):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts)], schema)


def awkward(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return docs_frame(spark, [None, "", " \t\n", "a", "one two three", long, long, "naïve café ☃ 𝄞 " * 30, "x" * 5000, "tie tie tie " * 40], [None, 1, 2, 3, 4, 5, 6, 7, 8, 8])


def clashing(docs):
    """docs with columns of every name that the stages use inside; each holds its own name, so that any change shows."""
    from pyspark.sql import functions as F

    names = "row key doc rep kept kept_text keeper stays n found score score_ toxic __text __base __runs __run __spans __clean __key __kept __toxic spans bands size set_a set_b copies label cell".split()
    return docs.select("*", *(F.lit(n).alias(n) for n in names)), names


def untouched(out, docs, names):
    assert out.columns == docs.columns
    return all(r[n] == n for r in out.collect() for n in names)
