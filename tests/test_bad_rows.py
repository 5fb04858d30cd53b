import pytest
from pyspark.sql import functions as F

from hitweave.plans.problems import HIT_FORM, READ_FORM
from hitweave.sources.bad_rows import assemble_records, parse_rows, rejected, valid

FORMS = {"Read": READ_FORM, "Hit": HIT_FORM}
GOOD = {"r1_2_3\tK12345": ("r1_2_3", "K12345"), '"r1_2_3"\t"Abc ""x"" d"': ("r1_2_3", 'Abc "x" d'), ' r1_2_3\tAbc def  \r': ("r1_2_3", "Abc def"), 'r1_2_3\t"Abc\tx"': ("r1_2_3", "Abc\tx"), "r1_2_3\tAbc " + "d" * 300_000: ("r1_2_3", "Abc " + "d" * 300_000)}
BAD = {
    "r1_2_3": "columns", "r1_2_3\tK1\tx": "columns", "r1_2_3,K12345": "columns", 'r1_2_3\t"Abc': "structure", '"r1_2_3"x\tK12345': "structure", 'r1_2_3\tAb"c"d': "structure", ' "r1_2_3"\tK12345': "structure",
    "r1_2_3\t": "value", "\tK12345": "value", "r1_2_3\tK1234": "value", "r1_2_3\tKI2345": "value", "r1_2\tK12345": "value", "r1_2_3\tabc": "value", "r1_2_3\tK12345\r\r": "structure", "r1_2_3\tAbc\x07d": "value", "r1_2_3\t\"Abc\" d": "structure", "1/3/2019\tK12345": "value",
}
NONE = [None, "", "  ", "\r", "# x\ty"]


def test_lines(spark):
    lines = [*GOOD, *BAD, *NONE, "head\ter"]
    df = spark.createDataFrame([(i, x, i == len(lines) - 1, "kept") for i, x in enumerate(lines)], "n int, line string, head boolean, reason string")
    out = parse_rows(df, "line", FORMS, keep=["n", "reason"], header=F.col("head")).cache()
    assert out.columns == ["n", "in_reason", "Read", "Hit", "reason"]
    assert {lines[r.n]: (r.Read, r.Hit) for r in valid(out).collect()} == GOOD
    assert {lines[r.n]: r.reason.split(":")[0] for r in rejected(out, ["Read", "Hit"]).collect()} == BAD
    assert parse_rows(df.limit(0), "line", FORMS).collect() == []


@pytest.mark.parametrize("block", [2, 1000])
def test_records_over_lines(spark, block):
    rows = [("f", 0, "a\tb"), ("f", 1, 'c\t"d'), ("f", 2, "e"), ("f", 3, None), ("f", 4, 'f"'), ("f", 5, 'g\t"h""i"'), ("g", 0, 'x"'), ("g", 1, "y")]
    got = assemble_records(spark.createDataFrame(rows, "file string, n int, line string"), "file", "n", "line", block=block).collect()
    assert {(r.file, r.first, r.n_lines, r.record) for r in got} == {("f", 0, 1, "a\tb"), ("f", 1, 4, 'c\t"d\ne\n\nf"'), ("f", 5, 1, 'g\t"h""i"'), ("g", 0, 1, 'x"'), ("g", 1, 1, "y")}
