import pyarrow as pa
import pytest

from hitweave.operators.packed import Packing, split_cells, split_packed

CASES = {
    None: [], "": [], "  ": [], "-": [], "n/a": [], "NA": [], "[]": [], '""': [], ";": [], "||": [], "<br>": [],
    "K00001": ["K00001"], " ko:K00001 ;K00002": ["ko:K00001", "K00002"], "K00001;;K00001;": ["K00001", "K00001"], "K00001 K00002,K00003/K00004": ["K00001", "K00002", "K00003", "K00004"],
    "K00001；K00002¦K00003<br>K00004\nK00005": ["K00001", "K00002", "K00003", "K00004", "K00005"], "['K00001', 'K00002']": ["K00001", "K00002"], '["K00001"]': ["K00001"],
    '"K00001;K00002"': ["K00001", "K00002"], "\"'K00001'\"": ["K00001"], '"Moss relay | Haze"; K00001': ["Moss relay | Haze", "K00001"], '"Moss relay ""Y"" form"': ['Moss relay "Y" form'],
    "Ember sensing, relay type;K00001": ["Ember sensing, relay type", "K00001"], "K00001;Ivory export\\;sensing": ["K00001", "Ivory export;sensing"], '"K00001¦K00002"': ["K00001", "K00002"],
    "K00001+K00002": ["K00001", "K00002"], 'K00001 "K00002" \'K00003\'': ["K00001", "K00002", "K00003"], "K00001;-;NA": ["K00001"], "alpha;beta;gamma": ["alpha", "beta", "gamma"], "red|green": ["red", "green"], "K00001; red, green": ["K00001", "red", "green"], " beta,gamma;Relay, drift type": ["beta", "gamma", "Relay, drift type"],
    '"K00001': ["K00001"],
}


def test_cells_together_and_alone():
    got = split_cells(pa.array(list(CASES), pa.string())).to_pylist()
    assert dict(zip(CASES, got)) == CASES
    for c, want in CASES.items():
        assert split_cells(pa.array([c], pa.string())).to_pylist() == [want]
    assert split_cells(pa.array(["x", *CASES], pa.string())[1:]).to_pylist() == list(CASES.values())
    assert split_cells(pa.array([], pa.string())).to_pylist() == []


def test_long_cell_and_other_ids():
    n = 30_000
    assert split_cells(pa.array([";".join(f"K{i:05d}" for i in range(n))])).to_pylist()[0] == [f"K{i:05d}" for i in range(n)]
    assert split_cells(pa.array(["X1 X2"]), Packing(id_form="X0", id_prefix="")).to_pylist() == [["X1", "X2"]]


def test_rows(spark):
    df = spark.createDataFrame([(1, "K00001;K00002", "a"), (1, "K00001;K00002", "a"), (None, "K00003", "b"), (4, None, "c")], "k int, cell string, item string")
    got = [(r.k, r.item_pos, r.item) for r in split_packed(df, "k", "cell").collect()]
    assert sorted(got, key=str) == sorted([(1, 1, "K00001"), (1, 2, "K00002")] * 2 + [(None, 1, "K00003")], key=str)
    assert split_packed(df.limit(0), "k", "cell").collect() == []
    assert split_packed(df, "k", "cell", names=("a", "b", "c")).columns == ["a", "b", "c"]
