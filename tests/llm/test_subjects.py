"""Subjects of held-out documents, and the edge cases."""

import random

import pytest

from tradeloom.llm.subjects import read, subjects_of

WORDS = {"law": ["court", "subpoena", "plaintiff", "tribunal", "juror"], "farming": ["maize", "cattle", "orchard", "fertiliser", "harvest"], "energy": ["pipeline", "refinery", "megawatt", "turbine", "drilling"]}
FRAMES = ["{who} wrote that {} would matter this year.", "Clippings on {} were pinned to the page by {who}.", "What remains unclear to {who} is {} in the district.", "Nobody on the committee had asked {who} about {} before."]
FORM = "See the attached list for the remaining items."


def documents(n, seed):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        own = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 2]))
        who = lambda: "".join(rng.choices("aeioubdklmnrst", k=8)).capitalize()
        parts = [rng.choice(FRAMES).format(rng.choice(WORDS[s]), who=who()) for s in own for _ in range(3)] + [FORM]
        other = rng.choice([s for s in WORDS if s not in own])
        parts.append(f"(A reader asked whether this has anything to do with {rng.choice(WORDS[other])}; it has not.)")
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), "x", [1]))
        labels += [(i, s) for s in own]
    return docs, labels


def test_held_out(spark):
    docs, labels = documents(500, 1)
    seen = [x for x in labels if x[0] < 300]
    docs += [(1000, None, "x", [1]), (1001, "", "x", [1]), (1002, " \n ", "x", [1]), (1003, "word " * 30_000, "x", [1]), (1004, "Zzz.", "x", [1])]
    df = spark.createDataFrame(docs, "doc_id long, text string, subject string, marks array<int>")
    lab = spark.createDataFrame([*seen, (7, None), (None, "law"), (99_999, "law")], "doc_id long, subject string")
    areas = spark.createDataFrame([(s,) for s in WORDS] + [(None,)], "subject string")
    got = {(r["doc_id"], r["subject"]) for r in subjects_of(df, lab, areas).collect()}
    late, wanted = {x for x in got if 300 <= x[0] < 1000}, {x for x in labels if x[0] >= 300}
    assert len(late & wanted) >= 0.95 * len(wanted) and len(late & wanted) >= 0.95 * len(late)
    assert not {1000, 1001, 1002, 1003, 1004} & {x[0] for x in got}


def test_nothing_to_go_by(spark):
    df = spark.createDataFrame([(1, "A court met. A court met again.")], "doc_id long, text string")
    lab, areas = spark.createDataFrame([], "doc_id long, subject string"), spark.createDataFrame([("law",)], "subject string")
    assert subjects_of(df, lab, areas).count() == 0 and subjects_of(df.where("false"), lab, areas).count() == 0 and subjects_of(df, lab, areas.where("false")).count() == 0


def test_reading():
    terms = read("NOTE 12\nPage 3 of 9. The re-\nfinery closed. (This has nothing to do with cattle.) <b>Done</b>")
    assert [len(s) for s in terms] == [1, 1, 3, 5, 1] and read(None) == read(" ") == []
    assert read("Page 3 is lost.") == read("Page 77 is lost.")


def found(spark, docs, labels):
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    lab, areas = spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(s,) for s in WORDS], "subject string")
    return {(r["doc_id"], r["subject"]) for r in subjects_of(df, lab, areas).collect()}


@pytest.mark.parametrize("copies", [1, 3, 12, 200])
def test_copies_keep_their_subject(spark, copies):
    docs, labels = documents(400, 2)
    parts = [FRAMES[i % 4].format(w, who=f"Mr{c * 5}") for i, (w, c) in enumerate(zip(WORDS["energy"], "abcde"))]
    for i in range(copies):  # up to a third of the rows, every other one with a sentence changed
        own = list(parts)
        if i % 2:
            own[i % 5] = own[i % 5].replace("Mr", "Ms" + "".join(random.Random(i).choices("aeiou", k=6)))
        docs.append((5000 + i, " ".join([*own, FORM]), "x", [1]))
    got = found(spark, docs, labels)
    assert {x for x in got if x[0] >= 5000} == {(5000 + i, "energy") for i in range(copies)}


def test_frequent_sentences_of_a_subject_count(spark):
    docs, labels = documents(400, 3)
    docs += [(5000 + i, f"The clerk wrote to number {i}. The court heard the plaintiff. The juror left the tribunal.", "x", [1]) for i in range(60)]
    got = found(spark, docs, labels + [(5000 + i, "law") for i in range(20)])
    assert {(5000 + i, "law") for i in range(60)} <= got


def test_wordings_are_learned_from_labels(spark):
    """Denials in words that no line of the library holds; in the other half of the labels the same words assert."""
    for end in ("never came up, quothe {who}.", "zumbrel afkantig {who}."):
        docs, labels = documents(500, 4)
        docs = [(i, t.replace("(A reader asked whether this has anything to do with", "Thus").replace("; it has not.)", " " + end.format(who="Fimmel")), *r) for i, t, *r in docs]
        got = found(spark, docs, [x for x in labels if x[0] < 300])
        late, wanted = {x for x in got if x[0] >= 300}, {x for x in labels if x[0] >= 300}
        assert len(late & wanted) >= 0.95 * len(wanted) and len(late & wanted) >= 0.95 * len(late)


def test_long_text_in_one_portion(spark):
    docs, labels = documents(300, 5)
    docs.append((9000, " ".join(FRAMES[i % 4].format(WORDS["farming"][i % 5], who="Ibbet") for i in range(60_000)), "x", [1]))
    assert (9000, "farming") in found(spark, docs, labels)
