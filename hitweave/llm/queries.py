"""The queries p1_, p2_, p6_, p7_, p8_ and p9_ on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.llm import linking, mixing, subjects, terms, tokens, topn
from hitweave.session import cut, load


#: From how many records on a term is no rare one; above which share of the records of its field it is a common one.
MIN_RECORDS, MAX_SHARE = 3, {"hit": 0.05, "c0": 0.5}


def _terms(spark: SparkSession, sf: str) -> terms.TermCounts:
    """The counts by two batches: all rows with their values in small letters, then a correction of the rows with white space
    around them, the old value removed and the clean one added."""
    reads, counts = load(spark, sf, "read_assignments", "taxcounts")
    raw = F.nullif(F.lower("hit"), F.lit(""))
    store = terms.TermCounts(spark)
    store.apply(terms.changes(reads, "hit", "read", raw).unionByName(terms.changes(counts, "c0", "sample", F.col("c0"))))
    store.apply(terms.corrections(reads, "hit", "read", raw, terms.clean_term(F.col("hit"))))
    return store


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf).marked(MIN_RECORDS, MAX_SHARE).where("mark is not null").select("field", "term")


def p1_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and records of every term, with its mark."""
    return _terms(spark, sf).marked(MIN_RECORDS, MAX_SHARE)


def p1_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts by three batches: all rows with their values as delivered, then what cleaning changes in them (the
    old value removed, the clean one added), then all rows of taxcounts added twice and removed once."""
    reads, counts = load(spark, sf, "read_assignments", "taxcounts")
    raw, clean = F.nullif(F.col("hit"), F.lit("")), terms.clean_term(F.col("hit"))
    dirty = reads.where(~raw.eqNullSafe(clean))
    c0 = F.col("c0")
    store = terms.TermCounts(spark)
    store.apply(terms.changes(reads, "hit", "read", raw).unionByName(terms.changes(counts, "c0", "sample", c0, 2)))
    store.apply(terms.changes(dirty, "hit", "read", raw, -1).unionByName(terms.changes(dirty, "hit", "read", clean)))
    store.apply(terms.changes(counts, "c0", "sample", c0, -1))
    store.compact()
    return store.marked(MIN_RECORDS, MAX_SHARE)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    hits, names = load(spark, sf, "hits", "taxon_names")
    return linking.link(hits, "hit_row", "hit_desc", names).select("hit_row", "taxid")


def p2_literal(spark: SparkSession, sf: str) -> DataFrame:
    """Of the entries found, those of descriptions that end in a name of one entry, in brackets and as it is listed."""
    hits, names = load(spark, sf, "hits", "taxon_names")
    one = names.groupBy("name").agg(F.countDistinct("taxid").alias("n"), F.min("taxid").alias("of")).where("n = 1 and name <> ''")
    said = hits.select("hit_row", F.regexp_extract("hit_desc", r"(?:^|\s)\[([^\[\]]+)\]$", 1).alias("name"))
    return p2_found(spark, sf).join(said.join(one, "name").select("hit_row"), "hit_row")


def p2_unlinked(spark: SparkSession, sf: str) -> DataFrame:
    """The rows whose description names no listed organism, with the description."""
    hits = load(spark, sf, "hits")
    return linking.unlinked(hits.select("hit_row", "hit_desc"), p2_found(spark, sf), "hit_row")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    hits, params = load(spark, sf, "hits", "filter_params")
    return topn.top_rows(hits, params, ("label", "read"), "hit", "score", "hit_row")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(load(spark, sf, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that the ids stand for: those of the documents again."""
    return tokens.decode(p7_ids(spark, sf))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Every block drawn, with its tokens and documents."""
    docs, targets = load(spark, sf, "documents", "mix_targets")
    return mixing.mixture(docs, targets)


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted and reached share of each source."""
    return mixing.shares(p8_mixture(spark, sf), load(spark, sf, "mix_targets"))


def p8_usage(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is used."""
    return mixing.usage(p8_mixture(spark, sf))


def p8_limits(spark: SparkSession, sf: str) -> DataFrame:
    """For each source: documents used more often than they may be, blocks that aren't of the fixed length (the last one of
    a source may be), and whether it has less than its share although it could give more; none, if all is well."""
    docs, targets = load(spark, sf, "documents", "mix_targets")
    drawn = cut(mixing.mixture(docs, targets), "drawn")
    shares = mixing.shares(drawn, targets)
    over = mixing.usage(drawn).join(targets.select("source", "max_repeats"), "source").where("uses > max_repeats").groupBy("source").agg(F.count("*").alias("over"))
    last = drawn.groupBy("source").agg(F.max("no").alias("last"))
    odd = drawn.join(last, "source").where((F.col("n_tokens") != mixing.BLOCK_TOKENS) & (F.col("no") < F.col("last"))).groupBy("source").agg(F.count("*").alias("odd"))
    total = shares.agg(F.sum("n_tokens").alias("total"))  # one row
    lacks = (F.col("n_tokens") > 0) & (F.col("n_tokens") + 2 * mixing.BLOCK_TOKENS < F.col("weight") * F.col("total")) & (F.col("repeats") < F.col("max_repeats"))
    out = shares.crossJoin(F.broadcast(total)).join(over, "source", "left").join(odd, "source", "left")
    return out.select("source", F.coalesce("over", F.lit(0)).alias("over"), F.coalesce("odd", F.lit(0)).alias("odd"), lacks.alias("lacks"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels, listed = load(spark, sf, "documents", "subject_labels", "subjects")
    found = subjects.assign(docs.withColumn("lang", F.substring("lang", 1, 2)), labels, listed)  # de, de-DE and DE are one
    return found.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """The make-up of the archive by subject; known subjects come before those found."""
    docs, labels, listed = load(spark, sf, "documents", "subject_labels", "subjects")
    return subjects.composition(p9_found(spark, sf).unionByName(labels.select("doc_id", "subject")), docs, listed)


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p1_after_changes, p2_found, p2_literal, p2_unlinked, p6_found, p7_ids, p7_decoded, p8_mixture, p8_shares, p8_usage, p8_limits, p9_found, p9_composition)}
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TERMS = f"""WITH x AS (
  SELECT 'hit' AS field, read AS record, nullif(lower(regexp_replace(hit, '^{_WHITE}+|{_WHITE}+$', '', 'g')), '') AS term FROM read_assignments
  UNION ALL SELECT 'c0', sample, CAST(c0 AS VARCHAR) FROM taxcounts),
t AS (SELECT field, term, count(*) AS n_rows, count(DISTINCT coalesce(record, chr(0))) AS n_records FROM x WHERE term IS NOT NULL GROUP BY ALL),
n AS (SELECT field, count(DISTINCT coalesce(record, chr(0))) AS total FROM x WHERE term IS NOT NULL GROUP BY ALL),
m AS (SELECT t.*, n_records < 3 AS rare, n_records > CASE field WHEN 'hit' THEN 0.05 ELSE 0.5 END * total AS common FROM t JOIN n USING (field)) """
_MARKED = _TERMS + "SELECT field, term, n_rows, n_records, CASE WHEN rare AND common THEN 'both' WHEN rare THEN 'rare' WHEN common THEN 'common' END AS mark FROM m"
SQL: dict[str, str] = {
    "p1_found": _TERMS + "SELECT field, term FROM m WHERE rare OR common",
    "p1_terms": _MARKED,
    "p1_after_changes": _MARKED,
    "p2_literal": r"""WITH o AS (SELECT name, min(taxid) AS taxid FROM taxon_names WHERE name <> '' GROUP BY name HAVING count(DISTINCT taxid) = 1)
SELECT hit_row, o.taxid FROM hits JOIN o ON o.name = regexp_extract(hit_desc, '(?:^|\s)\[([^\[\]]+)\]$', 1)""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_limits": "SELECT source, 0::BIGINT AS over, 0::BIGINT AS odd, false AS lacks FROM mix_targets",
    "p6_found": """WITH r AS (SELECT hit_row, label, read, hit, score, max(score) OVER (PARTITION BY label, read, hit) AS top,
  row_number() OVER (PARTITION BY label, read, hit ORDER BY score DESC, hit_row) AS nth_row, greatest(max(score) OVER (PARTITION BY label, read), 0) AS best
  FROM hits WHERE score IS NOT NULL),
s AS (SELECT *, dense_rank() OVER (PARTITION BY label, read ORDER BY top DESC, hit) AS nth_item FROM r)
SELECT param_id, hit_row FROM s, filter_params p
WHERE score >= CASE WHEN p.top_pct >= 0 THEN greatest(best - p.top_pct * best / 100, p.bits) ELSE p.bits END
  AND (hits_per_read = 0 OR nth_item <= hits_per_read) AND (hsps_per_hit = 0 OR nth_row <= hsps_per_hit)""",
}
