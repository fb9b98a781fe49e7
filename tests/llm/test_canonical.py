"""Free values meet the entry they mean, or none."""

import pytest

from tradeloom.llm.canonical import map_values

REFERENCE = [
    (1, "Hinzailron Devices plc Class A", "HNZ.A", None), (2, "Hinzailron Devices plc Class B", "HNZ.B", None), (3, "Grainkeax Equal Weight ETF", "GRAI", None), (4, "Grainkeax Short Treasury Fund Investor", "GRIXX", None),
    (5, "Bredddrios Port Commission Revenue 5.0% due 2034", None, None), (6, "Muckpilgum Pharmaceuticals Incorporated", "MUPI", "OLDM"), (7, "Jurquon Restaurants N.V.", "JQR", None), (8, "Jurquon Restaurants Notes 3.125% due 2032", None, None),
]
CASES = {
    "hinzailron devices plc cl b - common": 2, "HINZAILRQN DEVlCES CLASS A": 1, "Hinzailron Devices plc Class C": 0, "(SP) Grainkeax Equal Wt ETF": 3, "Grain keax Short Trsy Fund Inv": 4, "GrainkeaxEqual Weight ETF": 3,
    "Tovdrailo Equal Weight ETF": 0, "Sold: Bredddrios Port Comm Rev 5.0% due 01/01/2034": 5, "Bredddrios Port Commission Revenue 4.0% due 2034": 0, "Mückpìlgum Pharma": 6, "OLDM shares": 6, "Muckpilgum Ranch LLC (private)": 0,
    "Jurquon Restaurants Call option strike $55": 7, "JURQUON RESTAURANTS NOTES 3.125% DUE 2032": 8, "see attached statement": 0, "???": 0, "x" * 20_000: 0, "word " * 3000: 0,
}


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame([(*r, "v", "e") for r in REFERENCE], "asset_id long, canonical_name string, ticker string, former_ticker string, value string, entry string")


def test_cases(spark, reference):
    lines = [(i, t, "v", "r") for i, t in enumerate([*CASES, *CASES])] + [(900, None, "v", "r"), (901, "   ", "v", "r"), (902, "", "v", "r")]
    # noise words are told by how common they are among the values
    lines += [(1000 + i, f"Zzq{chr(97 + i % 26)}{chr(97 + i // 26)}ovtrum {w}", "v", "r") for i in range(200) for w in ("common stock", "Inc", "LLC (private)", "Ranch", "shares")]
    got = {r["line_no"]: r["asset_id"] for r in map_values(spark.createDataFrame(lines, "line_no long, t string, value string, row string"), "line_no", "t", reference).collect()}
    texts = [*CASES, *CASES]
    wrong = {texts[i]: got[i] for i in range(len(texts)) if got[i] != CASES[texts[i]]}
    assert not {900, 901, 902} & got.keys() and not wrong, {k[:60]: v for k, v in wrong.items()}


def test_empty(spark, reference):
    lines = spark.createDataFrame([(1, "Jurquon Restaurants")], "line_no long, t string")
    assert map_values(lines.where("false"), "line_no", "t", reference).count() == 0
    assert [r["asset_id"] for r in map_values(lines, "line_no", "t", reference.where("false")).collect()] == [0]
