"""Free-entered organisms to the entries of a list of names.

  1. The texts are reduced to distinct ones. From each, the places where an organism may stand are cut out (in brackets,
     after OS=, before a colon, behind commas) and normalised: lower case, no accents, one kind of blank, no qualifiers
     such as "Candidatus" or "subsp. nov."; a strain code at the end is split off. Letters and digits of any script stay.
     These mentions are made distinct too.
  2. Names are normalised in the same way. Character 2- and 3-grams of the names, weighted by their rarity, make an
     inverted index; every mention is scored against all names that share a gram with it by weighted cosine.
  3. All names whose cosine reaches a threshold are looked at, best first, until none can come that would change the
     choice. The best is accepted if it leads any other entry by a margin, has the same numbers, and its letters are
     within a few edits. Of a name with a listed strain code the strain is taken; if a species isn't listed, its
     first word is looked up as a genus in the same way. An initial in place of the genus is scored against names
     shortened alike; if several species fit, only a listed strain code decides.
  4. The mention with the best score gives the text's entry, and the texts are joined back to the rows. Texts of very
     many rows are joined by broadcast, so that no task gets all their rows.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.session import cut

#: Most names for which the index is broadcast; longer lists are scored by a join on grams.
MOST_NAMES = 200_000
HOT_SHARE = 1000
#: What an edit takes from a cosine.
EDIT_COST = 0.02

#: Qualifiers that are no part of a name.
_LEADING = re.compile(r"[\s()\[\]<>,;:]*(?:(?:candidatus|uncultured)\s*|(?:unclassified|environmental|multispecies:?|cf\.?|aff\.?)\s+)")
_TRAILING = re.compile(r"[\s,(]*(?:\(?type strain\)?|subsp\.? nov\.?|isolate\s*\w*|clone\s*\w*)[\s)]*$")
_CODE = re.compile(r"[\s,(]*(?:strain|str\.?|isolate)?[\s(:]*\b(?P<a>[a-z]{1,4})[-\s]?(?P<n>\d+)[\s)\]]*$")
_GLUED = re.compile(r"(?:strain|str\.?)[\s(:]*(?P<a>[a-z]{1,4})[-\s]?(?P<n>\d+)[\s)\]]*$")
_GENUS_ONLY = re.compile(r"[\s,]*(?:sp|spp)\.(?:\s.*)?$|\s(?:sp|spp)$")
_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"\d+")


@dataclass(frozen=True)
class Mention:
    """words: the name in small letters, words split by a blank; code: of a strain; genus: nothing below it is named."""

    words: str
    code: str = ""
    genus: bool = False

    @property
    def letters(self) -> str:
        return self.words.replace(" ", "")

    def key(self) -> str:
        return f"{self.words}|{self.code}|{int(self.genus)}"

    @staticmethod
    def of(key: str) -> Mention:
        w, c, g = key.split("|")
        return Mention(w, c, g == "1")


class _Folded:
    """A text in lower case, without accents, with what stands at its end (qualifiers, code, sp.) taken off; any of its
    ends is a mention."""

    def __init__(self, text: str):
        t = unicodedata.normalize("NFKD", text)
        t = "".join(c for c in t if not unicodedata.combining(c)).lower().replace("_", " ")
        self.text = " ".join(t.split()).rstrip(" []()<>,;:")
        t = _TRAILING.sub("", self.text)
        self.code, self.genus = "", bool(_GENUS_ONLY.search(t))
        if self.genus:
            t = _GENUS_ONLY.sub("", t)
        elif m := _GLUED.search(t) or _CODE.search(t):
            if _WORD.search(t, 0, m.start()):
                t, self.code = t[: m.start()], m["a"] + m["n"]
        self.core = t
        self.words = list(_WORD.finditer(t))
        self.starts = [w.start() for w in self.words]

    def end(self, start: int, most: int | None = None) -> Mention | None:
        """What is left from start on. Of more than most letters nothing but a genus can be found, its first word."""
        while m := _LEADING.match(self.core, start):
            start = m.end()
        words, n = [], 0
        if start and (w := _WORD.match(self.core, start)) and _WORD.match(self.core, start - 1):  # glued to its qualifier
            words, n = [w[0]], len(w[0])
        for i in range(bisect.bisect_left(self.starts, start), len(self.words)):
            words.append(self.words[i][0])
            n += len(words[-1])
            if most is not None and n > most:
                return Mention(words[0], "", True)
        return Mention(" ".join(words), self.code, self.genus) if words else None


def normalise(text: str) -> Mention:
    return _Folded(text).end(0) or Mention("")


def mentions(text: str, most: int | None = None) -> list[Mention]:
    """Where an organism may stand in a text, as mentions; the whole text is one of them. most: letters of the longest
    name that can be found, which keeps the work in proportion to the text."""
    t = " ".join(text.replace("\xa0", " ").split())
    m = re.search(r"\bOS=(.*?)(?: [A-Z]{2}=.*)?$", t)
    if m:
        found = [_Folded(m[1]).end(0, most)]
    elif (at := t.rfind("[")) >= 0 and t[at - 1 : at] in ("", " ") and (m := re.fullmatch(r"([^\[\]]+)\]?", t[at + 1 :])):
        found = [_Folded(m[1]).end(0, most)]
    else:
        f = _Folded(t)
        found = [f.end(0, most)]
        if ": " in t:
            found.append(_Folded(t.split(": ", 1)[0]).end(0, most))
        for mark in (": ", " - "):
            if (at := f.text.find(mark)) >= 0:
                found.append(f.end(at + len(mark), most))
        found += [f.end(m.end(), most) for m in re.finditer(r"(?<=.)\(|, ", f.text)]
    return list(dict.fromkeys(x for x in found if x))


def short(words: str) -> str:
    """The first word of a name of several by its initial."""
    first, _, rest = words.partition(" ")
    return f"{first[0]} {rest}" if rest and len(first) > 1 else words


def grams(words: str) -> set[str]:
    s = f"^{words.replace(' ', '')}$"
    return {s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)}


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b; most + 1 if more than most. Only the
    stretch of each row that can be within most is looked at."""
    if a == b:
        return 0
    n, far = len(b), most + 1
    if abs(len(a) - n) > most:
        return far
    before, row = [], [min(j, far) for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [far] * (n + 1)
        low = i - most
        if low <= 0:
            row[0] = i
            low = 1
        for j in range(low, min(n, i + most) + 1):
            y = b[j - 1]
            c = before[j - 1] + (x != y)
            if before[j] < c:
                c = before[j] + 1
            if row[j - 1] < c:
                c = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and last[j - 2] < c:
                c = last[j - 2] + 1
            row[j] = c if c < far else far
        if min(row) > most:
            return far
    return row[-1]


def spellings(name: str) -> list[tuple[str, str, bool]]:
    """(spelling, strain code, shortened) of a name: in full, and with an initial for the first of several words."""
    m = normalise(name)
    if not m.words:
        return []
    return [(m.words, m.code, False), *([(short(m.words), m.code, True)] if " " in m.words else [])]


class Names:
    """For each distinct spelling its (code, taxid) pairs, "" being the code of the name itself."""

    def __init__(self, entries: dict[str, set[tuple[str, int]]]):
        self.entries = entries
        self.spellings = sorted(entries)
        self.coded = {(s, c) for s, pairs in entries.items() for c, _ in pairs if c}

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Names:
        full: dict[str, set[tuple[str, int]]] = defaultdict(set)
        brief: dict[str, set[tuple[str, int]]] = defaultdict(set)
        for taxid, name in rows:
            for words, code, shortened in spellings(name):
                (brief if shortened else full)[words].add((code, taxid))
        return cls({**brief, **full})

    def taxids(self, spelling: str, code: str) -> tuple[set[int], bool]:
        """Taxids of a spelling, those of the strain if its code is listed (then true)."""
        pairs = self.entries[spelling]
        at = {t for c, t in pairs if code and c == code}
        return (at, True) if at else ({t for c, t in pairs if not c}, False)


@dataclass(frozen=True)
class Rules:
    """cosine: least cosine; margin: least lead over a name of another entry; per_edit: letters of a name that allow one
    edit; most_edits: edits allowed at most."""

    cosine: float = 0.35
    margin: float = 0.04
    per_edit: int = 5
    most_edits: int = 4


def most_edits(letters: int, rules: Rules) -> int:
    """Edits allowed for a mention of so many letters; the shortest have to be exact."""
    return min(rules.most_edits, max(1, letters // rules.per_edit)) if letters >= 4 else 0


def _initial(words: str) -> bool:
    """The first word is a single letter."""
    return words[1:2] in ("", " ")


class Index:
    """Inverted index of grams over spellings, with weighted cosines."""

    def __init__(self, names: Names, rules: Rules):
        self.names, self.rules = names, rules
        gram_sets = [grams(s) for s in names.spellings]
        single = [" " not in s for s in names.spellings]
        self.letters = np.array([len(s.replace(" ", "")) for s in names.spellings], dtype=np.int32)
        self.initial = np.array([_initial(s) for s in names.spellings], dtype=bool)
        df: dict[str, int] = defaultdict(int)
        for g in gram_sets:
            for x in g:
                df[x] += 1
        n = max(1, len(gram_sets))
        self.weight = {g: math.log(1 + n / k) ** 2 for g, k in df.items()}
        self.unseen = math.log(1 + n) ** 2
        posts: tuple = (defaultdict(list), defaultdict(list))
        self.lengths = np.array([math.sqrt(sum(self.weight[x] for x in g)) or 1.0 for g in gram_sets])
        for i, g in enumerate(gram_sets):
            for x in g:
                posts[0][x].append(i)
                if single[i]:
                    posts[1][x].append(i)
        self.posts = [{g: np.array(p, dtype=np.int64) for g, p in post.items()} for post in posts]
        self.first_words: dict[str, list[tuple[str, float]]] = {}

    def best(self, words: str, single: bool = False) -> list[tuple[str, float]]:
        """The spellings that can be accepted by cosine and length, best first; single-word ones only if single."""
        if not single:
            return self._best(words, False)
        if words not in self.first_words:  # few genera stand before many species
            if len(self.first_words) > 100_000:
                self.first_words.clear()
            self.first_words[words] = self._best(words, True)
        return self.first_words[words]

    def _best(self, words: str, single: bool) -> list[tuple[str, float]]:
        g = grams(words)
        post = self.posts[single]
        known = [x for x in g if x in post]
        if not known:
            return []
        norm = math.sqrt(sum(self.weight.get(x, self.unseen) for x in g))
        lists = [post[x] for x in known]
        w = np.repeat(np.array([self.weight[x] for x in known]), [len(p) for p in lists])
        score = np.bincount(np.concatenate(lists), w, len(self.lengths)) / (self.lengths * norm)
        n = len(words.replace(" ", ""))
        ok = np.flatnonzero(score >= self.rules.cosine)
        ok = ok[(np.abs(self.letters[ok] - n) <= most_edits(n, self.rules)) & (self.initial[ok] == _initial(words))]
        ok = ok[np.lexsort((ok, -score[ok]))]
        return [(self.names.spellings[i], s) for i, s in zip(ok.tolist(), score[ok].tolist())]


def _accept(names: Names, words: str, code: str, found: list[tuple[str, float]], rules: Rules) -> tuple[int, float] | None:
    """The entry of the best spelling, by threshold, margin, numbers and edits. found: by falling cosine."""
    letters = words.replace(" ", "")
    numbers = _NUMBER.findall(words)
    most = most_edits(len(letters), rules)
    good: dict[int, float] = {}
    strain: dict[int, float] = {}
    for spelling, cosine in found:
        # no score is above its cosine: behind these, nothing comes within the margin any more
        decided = good and cosine < max(good.values()) - rules.margin
        if decided and (not code or (strain and cosine < max(strain.values()) - rules.margin)):
            break
        if (decided and (spelling, code) not in names.coded) or cosine < rules.cosine or _initial(spelling) != _initial(words):
            continue
        if _NUMBER.findall(spelling) != numbers:
            continue
        d = edits(letters, spelling.replace(" ", ""), most)
        if d > most:
            continue
        ids, listed = names.taxids(spelling, code)
        score = cosine - EDIT_COST * d
        for t in ids:
            into = strain if listed else good
            into[t] = max(into.get(t, 0.0), score)
    for of in (strain, good):
        ranked = sorted(of.items(), key=lambda x: (-x[1], x[0]))
        if ranked and (len(ranked) == 1 or ranked[0][1] - ranked[1][1] >= rules.margin):
            return ranked[0]
    return None


def probes(mention: Mention) -> list[str]:
    """The words to look up as a whole name: all, and without numbers, as a name without them is listed more often than
    all that are told apart by numbers."""
    if mention.genus:
        return []
    plain = " ".join(_NUMBER.sub(" ", mention.words).split())
    return [mention.words] if plain in ("", mention.words) else [mention.words, plain]


def resolve(mention: Mention, names: Names, best, rules: Rules) -> tuple[int, float] | None:
    """Taxid and score of a mention. best(words, single): the spellings by cosine."""
    for words in probes(mention):
        hit = _accept(names, words, mention.code, best(words, False), rules)
        if hit:
            return hit
    first = mention.words if mention.genus else mention.words.partition(" ")[0]
    if first == mention.words and not mention.genus:
        return None
    hit = _accept(names, first, "", best(first, True), rules)
    return hit and (hit[0], hit[1] * 0.5)  # behind any mention whose whole name is known


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of the longest spelling of a batch."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([max((len(normalise(n).letters) for n in batch.column(0).to_pylist()), default=0)], pa.int32())], ["n"])


def link(rows: DataFrame, key_col: str, text_col: str, names: DataFrame, taxid_col: str = "taxid", name_cols: tuple[str, ...] = ("name", "unique_name"), rules: Rules = Rules(), most_names: int = MOST_NAMES) -> DataFrame:
    """(key_col, taxid, score) of the rows whose text names an entry of the list; rows without one have no row here, see
    unlinked().

    Null and empty texts name nothing. Equal texts get equal entries; repeated rows count each. A name of two entries
    names neither, unless a name of name_cols tells them apart. Null names and taxids are ignored. Texts of any length
    are read whole. Columns beside the named ones are ignored. Empty tables give an empty result.
    """
    listed = names.select(F.col(taxid_col).cast("int").alias("t"), F.explode(F.array(*[F.col(c) for c in name_cols])).alias("n")).where("t is not null and n is not null").distinct()
    head = listed.limit(most_names + 1).collect()
    x = rows.select(F.col(key_col).alias("k"), F.col(text_col).cast("string").alias("text")).where("trim(text) <> ''")
    texts = cut(x.groupBy("text").agg(F.count("*").alias("n")), "texts")

    # one number: no mention of more letters than the longest name and the edits allowed can name it
    longest = listed.select("n").mapInArrow(_letters, "n int").agg(F.max("n").alias("n")).collect()[0].n
    most = (longest or 0) + rules.most_edits

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[m.key() for m in mentions(t, most)] for t in batch.column(0).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([m for f in found for m in f], pa.string())], ["text", "mention"])

    found = cut(texts.select("text").mapInArrow(spread, "text string, mention string"), "mentions")
    # as many tasks as the session has: the rows are small, but each is scored against all names. By another expression than
    # that of distinct(), or Spark would take its partitions, which it merges by their bytes, for these
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = found.select("mention").distinct().repartition(parts, F.xxhash64("mention"))
    if len(head) <= most_names:
        scored = _by_broadcast(distinct, [(r.t, r.n) for r in head], rules)
    else:
        from hitweave.llm.linking_large import by_join

        scored = by_join(distinct, listed, rules)
    pick = F.max(F.struct("score", (-F.col("taxid")).alias("m")))
    entry = found.join(scored, "mention").groupBy("text").agg(pick.alias("p")).select("text", (-F.col("p.m")).cast("int").alias("taxid"), F.col("p.score").alias("score"))
    entry = cut(entry.join(texts, "text"), "entries")
    hot = texts.agg((F.sum("n") / HOT_SHARE).alias("limit"))
    hot = entry.crossJoin(F.broadcast(hot)).where("n > limit").drop("limit", "n")  # HOT_SHARE texts at most, limit is one row
    hot = F.broadcast(cut(hot, "hottexts"))
    by_hot = x.join(hot, "text")
    others = x.join(hot.select("text"), "text", "left_anti").join(entry.drop("n"), "text")
    return by_hot.unionByName(others).select(F.col("k").alias(key_col), "taxid", "score")


def _by_broadcast(distinct: DataFrame, rows: list[tuple[int, str]], rules: Rules) -> DataFrame:
    shared = distinct.sparkSession.sparkContext.broadcast(sorted(set(rows)))
    kept: dict[int, Index] = {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if 0 not in kept:
            kept[0] = Index(Names.of(shared.value), rules)
        index = kept[0]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            hits = [resolve(Mention.of(k), index.names, index.best, rules) for k in keys]
            ok = [(k, *h) for k, h in zip(keys, hits) if h]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in ok], pa.string()), pa.array([o[1] for o in ok], pa.int32()), pa.array([o[2] for o in ok], pa.float64())], ["mention", "taxid", "score"])

    return distinct.mapInArrow(score, "mention string, taxid int, score double")


def unlinked(rows: DataFrame, linked: DataFrame, key_col: str) -> DataFrame:
    """The rows of which no entry was found; a null key counts as not found."""
    return rows.join(linked.select(key_col).distinct(), key_col, "left_anti")
