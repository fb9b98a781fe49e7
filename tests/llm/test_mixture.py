"""Sources reach their shares within their caps, and the choice of copies is the same every time."""

from tradeloom.llm.mixture import emit_copies, mixture, mixture_report, repetition_rates, token_counts
from tradeloom.llm.tokens import TreeEncoder, vocabulary

TARGETS = [("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.2, 8), ("gone", 0.0, 3)]


def tables(spark):
    rows = [(i, "a", 10) for i in range(4000)] + [(10_000 + i, "b", 20) for i in range(700)] + [(20_000 + i, "c", 15) for i in range(150)]
    rows += [(30_000, None, 5), (30_001, "other", 5), (30_002, "a", None), (30_003, "a", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    counts, targets = tables(spark)
    for r in mixture_report(counts, targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.03 and r["most_repeats"] <= r["max_repeats"]
    got = mixture(counts, targets).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixture(counts.repartition(5), targets).collect()))
    assert not {30_000, 30_001, 30_002, 30_003} & {r["doc_id"] for r in got}
    assert emit_copies(mixture(counts, targets)).count() == sum(r["copies"] for r in got)


def test_a_larger_budget_meets_the_caps(spark):
    counts, targets = tables(spark)
    report = {r["source"]: r for r in mixture_report(counts, targets, budget=1e9).collect()}
    assert report["a"]["rate"] == 2 and report["c"]["tokens_used"] == 8 * 150 * 15


def test_empty_and_missing(spark):
    counts, targets = tables(spark)
    assert mixture(counts.where("false"), targets).count() == 0 and mixture(counts, targets.where("false")).count() == 0
    assert {r["actual_share"] for r in mixture_report(counts.where("false"), targets).collect()} == {None}
    sizes = spark.createDataFrame([("a", 100)], "source string, tokens long")
    assert {r["source"]: r["rate"] for r in repetition_rates(sizes, targets).collect()} == {"a": 2.0, "b": 0.0, "c": 0.0, "gone": 0.0}


def test_counts(spark):
    docs = spark.createDataFrame([(1, "two words", "a", 3), (2, None, "a", 3), (3, "", None, 3)], "doc_id long, text string, source string, n_tokens int")
    assert sorted((r["doc_id"], r["n_tokens"] or 0) for r in token_counts(docs).collect()) == [(1, 2), (2, 0), (3, 0)]


def test_shares_on_the_test_tables(spark, data):
    """What comes out, copy by copy and counted by direct encoding, has the target shares; rates are those of whole sums."""
    from tradeloom.llm.queries import p8_copies, p8_report

    docs, targets = (spark.read.parquet(f"{data}/{t}.parquet").toPandas() for t in ("documents", "mix_targets"))
    tree = TreeEncoder(vocabulary())
    size = {d: len(tree.encoding.encode_ordinary(t)) for d, t in zip(docs["doc_id"], docs["text"]) if t is not None}
    source = dict(zip(docs["doc_id"], docs["source"]))
    have, used, most = {}, {}, {}
    for d, n in size.items():
        have[source[d]] = have.get(source[d], 0) + n
    for r in p8_copies(spark, data).collect():
        used[r["source"]] = used.get(r["source"], 0) + size[r["doc_id"]]
        most[r["source"]] = max(most.get(r["source"], 0), r["copy_no"])
    room = min(m * have[s] / t for s, t, m in zip(targets["source"], targets["target_share"], targets["max_repeats"]) if t > 0 and have.get(s))
    report = {r["source"]: r for r in p8_report(spark, data).collect()}
    present = sum(t for s, t in zip(targets["source"], targets["target_share"]) if have.get(s))  # a source without documents gives nothing
    for s, t, m in zip(targets["source"], targets["target_share"], targets["max_repeats"]):
        assert report[s]["tokens_used"] == used.get(s, 0) and abs(report[s]["actual_share"] - used.get(s, 0) / sum(used.values())) < 1e-12 and most.get(s, 0) <= m
        assert abs(report[s]["rate"] - (min(t * room / have[s], m) if have.get(s) else 0)) < 1e-9
        assert abs(report[s]["actual_share"] - (t / present if have.get(s) else 0)) < 0.1
