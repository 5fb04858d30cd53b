import pytest

from hitweave.llm import linking
from hitweave.llm.linking import edits, link, mentions, normalise, unlinked

NAMES = [
    (1, "Brevadibacter", None), (2, "Brevadibacter roltotica", None), (3, "Brevadibacter roltotica str. QX 512", None), (4, "Mundella", None), (5, "Mundella cutudans", None),
    (6, "kelp rust germ of Hask", None), (7, "Gemellia", "Gemellia <north>"), (8, "Gemellia", "Gemellia <south>"), (9, "Brevadibacter lanatus", None), (10, "Bomella lanatus", None),
    (20, "Human tornavirus 16", None), (21, "Human tornavirus 18", None), (22, "Human tornavirus", None), (23, "Вирус табачный", None), (24, "HPX 7", None), (25, "Ae", None), (26, "Longa " + "abcdefghij " * 24 + "x", None), (None, "nameless", None), (11, None, None),
]
CASES = {
    "some enzyme [Brevadibacter roltotica str. QX 512]": 3, "some enzyme, brevadibacter_roltotica, strain qx-512": 3, "BREVADIBACTER ROLTOTICA (QX512): pump": 3, "x [Brevadibacter roltotica str. QX 513]": 2,
    "pump, subunit B - Brevadibcater roltotica": 2, "[Fe-S] carrier OS=Brevadibacter rolttica PE=4": 2, "x [Brevadibacterroltotica": 2, "x (B. roltotica (QX 512))": 3, "x [Brevadibacter gluvium]": 1,
    "uncultured Mundella sp. CCU-1": 4, "Candidatus Mundella\xa0cutudans subsp. nov.": 5, "kelp-rust-germ-of-Hask": 6, "x [Gemellia]": None, "x [Gemellia <north>]": 7, "x [B lanatus]": None, "hypothetical protein": None,
    "[Human tornavirus 18]": 21, "coat protein, Human tornavirus 16": 20, "[Human tornavirus 17]": 22, "x [вирус_табачный]": 23, "x [HPX 7]": 24, "x [Ae]": 25, "pump, LONGA " + "abcdefghij " * 24 + "x": 26, "unculturedBrevadibacter sp.": 1,
    "a, " * 3000 + "Mundella cutudans": 5, "[Brevadibacter roltoticaQX7777": 2, "x [Unknownia listeria]": None, "": None, " ": None, None: None, "word " * 4000: None,
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(100 + i, "x [Mundella cutudans]") for i in range(30)]
    hits = spark.createDataFrame(rows, "k long, d string").selectExpr("*", "1 as taxid", "2 as text")
    return rows, hits, spark.createDataFrame(NAMES, "taxid int, name string, unique_name string")


def test_cases_by_index_and_by_join(tables):
    rows, hits, names = tables
    want = {(i, CASES[t]) for i, t in rows[: len(CASES)] if CASES[t]} | {(100 + i, 5) for i in range(30)}
    got = link(hits, "k", "d", names)
    assert {(r.k, r.taxid) for r in got.collect()} == want
    assert {(r.k, r.taxid) for r in link(hits, "k", "d", names, most_names=0).collect()} == want
    assert {r.k for r in unlinked(hits.select("k"), got, "k").collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_empty(spark, tables):
    _, hits, names = tables
    assert link(hits.limit(0), "k", "d", names).collect() == []
    assert link(hits, "k", "d", names.limit(0)).collect() == []


def test_parts():
    assert edits("abcd", "abdc", 3) == 1 and edits("abc", "abc", 0) == 0 and edits("abc", "xyz", 2) == 3 and edits("a", "abcde", 2) == 3
    assert normalise("Candidatus Ab_cd str. QX-12") == linking.Mention("ab cd", "qx12")
    assert [m.words for m in mentions("enzyme [Ab cd]")] == ["ab cd"]


def test_mentions_are_as_long_as_the_text():
    text = "word, (" * 20_000 + "Mundella cutudans"
    found = mentions(text, 40)
    assert linking.Mention("mundella cutudans") in found and sum(len(m.words) for m in found) < 4 * len(text)


def perturbed(rng, name, code):
    """name as it is written freely: a slip, other case, underscores, glued or odd marks around it."""
    def slip(w):
        i = rng.randrange(1, len(w) - 1)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :], w])

    words = [slip(w) if rng.random() < 0.25 and len(w) > 5 else w for w in name.split(" ")]
    t = rng.choice([" ", "_", "  "]).join(words)
    t = rng.choice([str, str, str.upper, str.lower])(t)
    if code:
        t += rng.choice([" str. {} {}", ", strain {}-{}", " ({}{})", " {} {}"]).format(*code)
    return rng.choice(["pump [{}]", "pump, subunit B [ {} ]", "kinase OS={} PE=4", "kinase - {}", "kinase, {}", "{}: pump", "{}", "pump ({})", "[{}"]).format(t)


def test_recall_and_precision_on_written_labels(spark):
    """2,000 written texts, of which the entry is known."""
    import random
    import re

    rng = random.Random(7)
    syllables = ["bre", "va", "lor", "ti", "mu", "ske", "dan", "plo", "gri", "xa", "nu", "fio"]
    made, names, species = set(), [], []
    while len(species) < 400:
        genus = "".join(rng.choices(syllables, k=rng.randint(3, 4))).capitalize() + rng.choice(["bacter", "monas", "vibrio", "ella"])
        if genus in made:
            continue
        made.add(genus)
        names.append((len(names) + 1, genus, None))
        for _ in range(3):
            name = f"{genus} {''.join(rng.choices(syllables, k=3))}{rng.choice(['us', 'um', 'ensis'])}"
            if name not in made:
                made.add(name)
                names.append((len(names) + 1, name, None))
                species.append((len(names), name))
                if rng.random() < 0.3:
                    names.append((len(names) + 1, f"{name} str. QX {rng.randint(100, 9999)}", None))
    listed = [(t, *re.match(r"(.*?)(?: str\. (\w+) (\d+))?$", n).groups()) for t, n, _ in names if " " in n]
    rows = []
    for i in range(2000):
        if rng.random() < 0.15:
            stranger = "".join(rng.choices("aeioukwhjqz", k=9)).capitalize() + " " + "".join(rng.choices("aeioukwhjqz", k=8))
            rows.append((i, perturbed(rng, stranger, None), None))
        else:
            t, name, letters, number = rng.choice(listed)
            rows.append((i, perturbed(rng, name, (letters, number) if letters else None), t))
    hits = spark.createDataFrame([r[:2] for r in rows], "k long, d string")
    got = {r.k: r.taxid for r in link(hits, "k", "d", spark.createDataFrame(names, "taxid int, name string, unique_name string")).collect()}
    true = {i: t for i, _, t in rows if t}
    both = sum(got.get(i) == t for i, t in true.items())
    print("recall", both / len(true), "precision", both / len(got))
    assert both / len(true) >= 0.97 and both / len(got) >= 0.97
