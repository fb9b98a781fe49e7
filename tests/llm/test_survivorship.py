"""Which record supplies each field, by a plain search, and how filings are told."""

from datetime import datetime

from pyspark.sql import functions as F

from tradeloom.llm.survivorship import filing_key, says_something, sources_of_fields, survivors

SCHEMA = "record_no long, filing_id string, doc_url string, source_id string, ingested_at timestamp_ntz, a string, n int, key__ string, value string, trust_rank int"
U = "00136f55-5c74-43a4-aaaf-c9fdfd221dc0"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], SCHEMA)
    trust = spark.createDataFrame([("good", 1), ("poor", 5)], "source_id string, trust_rank int")
    s = survivors(df, filing_key(F.col("filing_id"), F.col("doc_url")), "record_no", ["a", "n"], "source_id", "ingested_at", trust)
    return sorted((r["first_record"], r["field_name"], r["record"], r["value"]) for r in sources_of_fields(s, ["a", "n"]).collect())


def t(day):
    return datetime(2024, 1, day)


def test_trust_then_time_then_number(spark):
    rows = [
        (1, "house_007", None, "poor", t(9), "late", 1), (2, "HOUSE#7", None, "good", t(1), "N/A", None), (3, " house-7/ ", None, "good", t(2), "v3", None),
        (4, "7", None, "good", t(2), "v4", 4), (5, None, "ptr/7.pdf", None, t(20), "v5", 5), (6, "house_8", None, "good", t(2), "alone", 1),
    ]
    assert run(spark, rows) == [(1, "a", 3, "v3"), (1, "n", 4, "4")]


def test_shortened_ids(spark):
    rows = [(1, f"senate_{U}", None, "poor", t(1), "x", None), (2, "senate_00136f55", None, "good", t(1), "y", None), (3, f"{{{U.upper()}}}", None, None, None, " ", 3), (4, None, f"view/ptr/{U}/", "nobody", None, "-", None)]
    assert run(spark, rows) == [(1, "a", 2, "y"), (1, "n", 3, "3")]


def test_ids_cut_anywhere(spark):
    other = "00136f99" + U[8:]
    whole = [(1, f"senate_{U}", None, "poor", t(1), "x", None), (2, f"senate_{other}", None, "poor", t(1), "o", None)]
    cut = lambda i, text: (i, f"senate_{text}", None, "good", t(1), f"v{i}", None)
    # 7 characters that both ids start with tell nothing; one more, or nearly all, do; what starts like none stays apart
    assert run(spark, [*whole, cut(3, "00136f5"), cut(4, "00136f9")]) == [(1, "a", 3, "v3"), (2, "a", 4, "v4")]
    assert run(spark, [*whole, cut(3, "00136f"), cut(4, "00136f"), cut(5, U[:-1])]) == [(1, "a", 5, "v5"), (3, "a", 3, "v3")]
    assert run(spark, [*whole, cut(3, "beef"), cut(4, "x" * 500), cut(5, U + "0")]) == []


def test_repeats_nulls_and_nothing(spark):
    rows = [(1, "5", None, None, None, None, None), (1, "5", None, None, None, None, None), (2, "n/a", None, "good", t(1), "z", 1), (3, None, None, "good", t(1), "z", 1)]
    assert run(spark, rows) == [] and run(spark, []) == []


def test_words_that_say_nothing(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", " ", "--", "N/A", "unknown", "None", "ok", "é", "x" * 100_000)], "c string")
    assert [r[0] for r in df.select(says_something(F.col("c"))).collect()] == [False] * 7 + [True] * 3
