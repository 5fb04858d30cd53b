import random

import pytest

from hitweave.llm import tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.tokenizer_path())


def texts():
    rng = random.Random(5)
    out = ["", " ", "a", "don't stop", "<|endoftext|> is text", "x" * 3000, " \n\t" * 900 + "end", "''''" * 500, "中文字符日本語" * 300, "\r\n".join("word" * 3 for _ in range(400))]
    for _ in range(20):
        out.append("".join(rng.choice(["the ", "quick", "don't", "é", "42", "\n\n", "  ", "=-", "a" * 90, "'s"]) for _ in range(rng.randint(1, 900))))
    return out


@pytest.mark.parametrize("chunk,reach,leaf", [(300, 40, 16), (700, 4096, 64), (1 << 18, 4096, 4096)])
def test_segments_give_the_ids_of_the_whole(enc, monkeypatch, chunk, reach, leaf):
    monkeypatch.setattr(tokens, "REACH", reach)
    monkeypatch.setattr(tokens, "LEAF", leaf)
    for t in texts():
        parts = list(enc.segments(t, chunk))
        assert "".join(p for p, _ in parts) == t
        assert enc.tree([enc.part(p) for p, _ in parts], [g for _, g in parts]) == enc.enc.encode_ordinary(t)


def test_word_as_tree_of_halves(enc):
    rng = random.Random(1)
    for t in ["a" * 999, "".join(rng.choice("abth") for _ in range(2000))]:
        assert enc.word(t.encode(), 16) == enc.enc.encode_ordinary(t)


def test_rows(spark, enc):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(0, None, "y"), (None, "null id", "z"), (7, "twice", "x"), (7, "twice", "x"), (8, "long " * 2000, "x"), (8, "long " * 2000, "x")]
    df = spark.createDataFrame(rows, "k long, t string, row string")
    got = [(r.k, r.row, tuple(r.ids)) for r in tokens.encode(df, "k", "t", chunk=500, keep=("row",)).collect()]
    want = [(k, x, tuple(enc.ids(t) if t else [])) for k, t, x in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokens.encode(df.limit(0), "k", "t").collect() == []
    back = [(r.k, r.t) for r in tokens.decode(tokens.encode(df, "k", "t", chunk=500), text_col="t").collect()]
    assert sorted(back, key=str) == sorted([(k, t or "") for k, t, _ in rows], key=str)
    with pytest.raises(ValueError):
        tokens.encode(df.withColumnRenamed("row", "ids"), "k", "t", keep=("ids",))
