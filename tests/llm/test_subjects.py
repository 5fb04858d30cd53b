import base64
import random

from hitweave.llm import subjects
from hitweave.llm.mail import own_words

TOPICS = {
    "sport": {"en": "goalkeeper striker halftime referee penalty scoreboard dribble playoff", "de": "torwart stürmer halbzeit schiedsrichter elfmeter tabelle heimspiel trainer"},
    "law": {"en": "bailiff verdict testimony affidavit tort probate easement counsel", "de": "gericht urteil zeuge klage vertrag notar anwalt vollmacht"},
}


def message(rng, topic, lang):
    words = (TOPICS[topic][lang] if topic else "hello there").split()
    frame = {"en": "we still have to look at the {} before anyone decides about the {}.", "de": "zum thema {} gibt es viele anmerkungen und auch zu {} noch mehr."}[lang]
    return " ".join(frame.format(rng.choice(words), rng.choice(words)) for _ in range(8)) if topic else {"en": "Thanks, got it.", "de": "Mach ich."}[lang]


def test_held_out_accuracy(spark):
    rng = random.Random(0)
    truth, rows = {}, []
    for i in range(400):
        lang, topic = rng.choice(["en", "en", "de"]), rng.choice(["sport", "law", None])
        text = message(rng, topic, lang)
        if i % 7 == 0:
            text = "From: a@b.c\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(text.encode()).decode()
        truth[i] = topic
        rows.append((i, text, lang, "x"))
    rows += [(1000, None, None, "x"), (1001, "", "en", "x"), (1002, " \n", "en", "x"), (1003, rows[5][1], rows[5][2], "x"), (1003, rows[5][1], rows[5][2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, subject string")
    labels = spark.createDataFrame([(i, t) for i, t in truth.items() if t and i % 4 == 0], "doc_id long, subject string")
    listed = spark.createDataFrame([("sport", "games"), ("law", "courts"), ("music", "bands")], "subject string, description string")
    got = {}
    for r in subjects.assign(docs, labels, listed, settings=subjects.Settings(dims=16, most_rate=0.35)).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    right = sum(got.get(i, [None]) == [t] for i, t in truth.items())
    assert right / len(truth) > 0.95
    assert not {1000, 1001, 1002} & set(got)
    assert got.get(1003, []) == got.get(5, []) * 2
    share = {r.subject: r for r in subjects.composition(subjects.assign(docs, labels, listed, settings=subjects.Settings(dims=16, most_rate=0.35)).distinct(), docs.selectExpr("doc_id", "length(text) as n_chars"), listed).collect()}
    assert set(share) == {"sport", "law", "music", None}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    listed = spark.createDataFrame([("a", "b")], "subject string, description string")
    assert subjects.assign(docs, labels, listed).collect() == []
    one = spark.createDataFrame([(1, "some words here", "en")] * 9, "doc_id long, text string, lang string")
    assert subjects.assign(one, labels, listed.limit(0)).collect() == []
    assert subjects.assign(one, labels, listed).collect() == []


def test_own_words():
    assert own_words(None) == own_words("") == ""
    text = "From: A B <a@b.c>\nSubject: goal\n\nHi C,\n\nmy words\n\nPS: not this\n\n(nor this)\n\nBest,\nA\n-- \nA B\nChief\n\nThis is confidential.\n\nOn 1 May 2014, C <c@d.e> wrote:\n> old words\n"
    assert own_words(text) == "Hi C,\n\nmy words"
    html = "Content-Type: text/html\n\n<html><body><p>caf&eacute;</p><blockquote>old</blockquote></body></html>"
    assert own_words(html) == "café"
    assert own_words("-----Original Message-----\nFrom: Ann Lee <a@b.c>\nSent: today\n\nHer words\n\nBest,\nAnn\n\nmine\n") == "mine"
    assert own_words("Content-Transfer-Encoding: quoted-printable\n\ncaf=C3=A9 and=\n so on") == "café and so on"
    assert own_words("passÃ© la journÃ©e") == "passé la journée"
    assert len(own_words("long words " * 50_000)) > 500_000
