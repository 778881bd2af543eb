"""Rows that every operator must take: null and repeated ids, null, empty and long texts, clashing columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, n_words int, spans string, id string, copy binary, score double, words array<string>"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "x", "y", b"z", 0.5, ["w"]) for i, t in zip(ids, texts)], SCHEMA)


def odd(spark, *more):
    texts = [None, "", " \n\t", "word", "word", "wörd " * 3000, "a", *more]
    return documents(spark, texts, [None, 0, 1, 2, 2, 3, None, *range(10, 10 + len(more))])


def empty(spark):
    return documents(spark, []).where(F.lit(True))


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id bigint, quality int")
