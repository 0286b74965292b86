"""Queries of this subpackage over the test tables and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import leakage, packing, percentiles, runs, shared_spans, spam, topn
from helixframe.session import cut, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "bas_reads"), "read_id", "basecall", least=60)


def p3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal repeats of 60 letters or more between reads."""
    found = shared_spans.maximal_repeats(table(spark, sf_dir, "bas_reads"), "read_id", "basecall", least=60)
    return found.select(F.md5("repeat").alias("repeat"), "length", "n_records", "n_places")


def p3_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each read is shared with other reads."""
    reads = table(spark, sf_dir, "bas_reads").where("read_id is not null").groupBy("read_id").agg(F.max(F.length("basecall")).alias("n_bases"))
    shared = p3_found(spark, sf_dir).groupBy("read_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"), F.count("*").alias("n_spans"))
    rows = reads.join(shared, "read_id", "left").fillna(0, ["n_bases", "n_shared", "n_spans"])
    return rows.select("*", F.when(F.col("n_bases") > 0, F.round(F.col("n_shared") / F.col("n_bases"), 6)).alias("share"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf_dir, "bas_reads"), "read_id", "basecall", "merge_qv", limit=2, least=4).select("read_id", "first_base", "last_base")


def p4_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run as one event: place, letter, number of bases and duration."""
    return runs.collapse_runs(table(spark, sf_dir, "bas_reads"), "read_id", "basecall", "merge_qv", limit=2, least=4, duration="width_in_frames")


def p4_mean_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs merged by the means of their merge_qv, the nearest first, across one unknown base at most."""
    return runs.collapse_runs(table(spark, sf_dir, "bas_reads"), "read_id", "basecall", "merge_qv", limit=2, least=4, duration="width_in_frames", linkage=runs.MEAN, max_gap=1)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, sf_dir, "alignment_index"), ["movie_id", "hole_number"], "map_qv", "aln_id", 3).select("movie_id", "hole_number", "aln_id")


METRICS = ["ipd", "pulse_width", "quality_value"]
PER_MILLE = [10, 100, 500, 900, 990, 999]


def _select(summary: DataFrame) -> DataFrame:
    """Percentiles per movie and, under a null movie_id with scope 'all', of all movies. rank_error is the stated bound."""
    found = percentiles.multi_select(summary, ["movie_id"], PER_MILLE, {"movie": ["movie_id"], "all": []})
    return found.withColumn("rank_error", F.lit(0).cast("long"))


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "exp_group_metrics")
    return _select(percentiles.summarise(rows, ["movie_id"], METRICS, ["aln_id", "base_offset"]))


def p7_percentiles_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, combined from one summary per load_day."""
    rows = table(spark, sf_dir, "exp_group_metrics")
    days = percentiles.summarise(rows, ["movie_id"], METRICS, ["aln_id", "base_offset"], part=["load_day"])
    return _select(percentiles.merge(days, groups=["movie_id"]))


def _index(spark: SparkSession, sf_dir: str) -> leakage.Index:
    return leakage.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.phrase_search(_index(spark, sf_dir), table(spark, sf_dir, "eval_items"), "item_id", "item_text", n=10)


def p9_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the passages stand: the longest common stretches of ten words or more, by word places in document and item."""
    return leakage.phrase_matches(_index(spark, sf_dir), table(spark, sf_dir, "eval_items"), "item_id", "item_text", n=10)


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which the eight rarest words of an item stand within 30 words of the rarest."""
    return leakage.proximity_search(_index(spark, sf_dir), table(spark, sf_dir, "eval_items"), "item_id", "item_text", terms=8, within=30)


CAPACITY = 2048


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packing.measure(table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY)
    return packing.pack(items, ["doc_id", "piece"], "n_tokens", CAPACITY)


def _page_model(spark: SparkSession, sf_dir: str) -> spam.Model:
    return spam.calibrate(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", table(spark, sf_dir, "page_labels"), "page_label", "spam")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.junk_pages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", _page_model(spark, sf_dir))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's words in junk stretches."""
    return spam.junk_shares(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", _page_model(spark, sf_dir))


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares, "p8_containers": p8_containers, "p9_found": p9_found, "p9_near": p9_near, "p9_matches": p9_matches, "p7_percentiles": p7_percentiles, "p7_percentiles_from_days": p7_percentiles_from_days, "p3_found": p3_found, "p3_share": p3_share, "p3_repeats": p3_repeats, "p4_found": p4_found, "p4_events": p4_events, "p4_mean_runs": p4_mean_runs, "p5_found": p5_found}

_P3 = """
d AS (SELECT DISTINCT read_id, basecall FROM bas_reads WHERE length(basecall) >= 60),
k AS (SELECT read_id, p, substring(basecall, CAST(p AS BIGINT) + 1, 60) AS w FROM (SELECT read_id, basecall, unnest(range(length(basecall) - 59)) AS p FROM d)),
c AS (SELECT * FROM k WHERE regexp_full_match(w, '[ACGT]+')),
h AS (SELECT w FROM c GROUP BY w HAVING min(read_id) <> max(read_id)),
s AS (SELECT DISTINCT read_id, p AS s, p + 60 AS e FROM c WHERE w IN (SELECT w FROM h)),
m AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY read_id ORDER BY s) >= s THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM m),
f AS (SELECT read_id, CAST(min(s) AS INTEGER) AS span_start, CAST(max(e) AS INTEGER) AS span_end FROM g GROUP BY read_id, island)
"""

_P4 = """
d AS (SELECT DISTINCT read_id, basecall, merge_qv, width_in_frames FROM bas_reads WHERE basecall IS NOT NULL),
b AS (SELECT read_id, p, upper(basecall[CAST(p AS BIGINT) + 1]) AS c, merge_qv[p + 1] AS q, width_in_frames[p + 1] AS wf FROM (SELECT *, unnest(range(length(basecall))) AS p FROM d)),
l AS (SELECT *, lag(c) OVER w AS pc, lag(q) OVER w AS pq FROM b WINDOW w AS (PARTITION BY read_id ORDER BY p)),
r AS (SELECT *, sum(CASE WHEN c = pc AND c <> 'N' AND abs(q - pq) <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY read_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM l),
e AS (SELECT read_id, CAST(min(p) AS INTEGER) AS first_base, CAST(max(p) AS INTEGER) AS last_base, CAST(count(*) AS INTEGER) AS n_bases, any_value(c) AS base,
      CAST(sum(wf) AS BIGINT) AS duration FROM r WHERE c <> 'N' AND q IS NOT NULL GROUP BY read_id, run HAVING count(*) >= 4)
"""

_P7 = """WITH d AS (SELECT DISTINCT aln_id, base_offset, movie_id, ipd, pulse_width, quality_value FROM exp_group_metrics),
l AS (SELECT movie_id, 'ipd' AS field, CAST(ipd AS DOUBLE) AS v FROM d UNION ALL SELECT movie_id, 'pulse_width', CAST(pulse_width AS DOUBLE) FROM d
      UNION ALL SELECT movie_id, 'quality_value', CAST(quality_value AS DOUBLE) FROM d),
s AS (SELECT 'movie' AS scope, movie_id, field, v FROM l WHERE v IS NOT NULL UNION ALL SELECT 'all', NULL, field, v FROM l WHERE v IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, movie_id, field ORDER BY v) AS k, count(*) OVER (PARTITION BY scope, movie_id, field) AS n FROM s)
SELECT scope, movie_id, field, q AS per_mille, v AS value, n, CAST(0 AS BIGINT) AS rank_error
FROM r, (SELECT CAST(unnest([10, 100, 500, 900, 990, 999]) AS INTEGER) AS q) WHERE k = greatest(1, (n * q + 999) // 1000)"""

_P9 = r"""WITH w AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(regexp_replace(text, '[\x{AD}\x{200B}-\x{200D}\x{FEFF}]', '', 'g')), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(regexp_replace(item_text, '[\x{AD}\x{200B}-\x{200D}\x{FEFF}]', '', 'g')), '[\p{L}\p{N}]+') FROM eval_items WHERE item_text IS NOT NULL),
g AS (SELECT DISTINCT kind, id, array_to_string(list_slice(ws, p, p + 9), ' ') AS s FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 8)) AS p FROM w))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.s = i.s WHERE d.kind = 'd' AND i.kind = 'i'"""

_WORDS = r"regexp_extract_all(lower(regexp_replace({}, '[\x{{AD}}\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g')), '[\p{{L}}\p{{N}}]+')"
_P9_WORDS = f"""WITH dw AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS p, unnest(ws) AS word FROM (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents WHERE text IS NOT NULL)),
iw AS (SELECT item_id, generate_subscripts(ws, 1) - 1 AS p, unnest(ws) AS word FROM (SELECT item_id, {_WORDS.format('item_text')} AS ws FROM eval_items WHERE item_text IS NOT NULL))"""
_P9_MATCHES = rf"""{_P9_WORDS},
l AS (SELECT 'd' AS kind, doc_id AS id, {_WORDS.format('text')} AS ws FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, {_WORDS.format('item_text')} FROM eval_items WHERE item_text IS NOT NULL),
g AS (SELECT kind, id, p, array_to_string(list_slice(ws, p, p + 9), ' ') AS s FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 8)) AS p FROM l)),
h AS (SELECT d.id AS doc_id, i.id AS item_id, d.p AS dp, i.p AS ip FROM g d JOIN g i ON d.s = i.s WHERE d.kind = 'd' AND i.kind = 'i'),
r AS (SELECT *, ip - row_number() OVER (PARTITION BY doc_id, item_id, dp - ip ORDER BY ip) AS run FROM h)
SELECT doc_id, item_id, CAST(min(dp) - 1 AS INTEGER) AS doc_word, CAST(min(ip) - 1 AS INTEGER) AS item_word, CAST(count(*) + 9 AS INTEGER) AS n_words FROM r GROUP BY doc_id, item_id, dp - ip, run"""
_P9_NEAR = f"""{_P9_WORDS},
c AS (SELECT word, count(*) AS n FROM dw GROUP BY word),
k AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY n, word) AS o FROM (SELECT DISTINCT item_id, word FROM iw) JOIN c USING (word)),
e AS (SELECT k.* FROM k WHERE o <= 8 AND item_id IN (SELECT item_id FROM k WHERE o = 8)),
a AS (SELECT doc_id, item_id, p FROM dw JOIN e USING (word) WHERE o = 1)
SELECT DISTINCT doc_id, item_id FROM (SELECT a.doc_id, a.item_id, a.p FROM a JOIN e ON a.item_id = e.item_id AND e.o > 1 JOIN dw ON dw.doc_id = a.doc_id AND dw.word = e.word AND abs(dw.p - a.p) < 30
GROUP BY a.doc_id, a.item_id, a.p HAVING count(DISTINCT e.o) = 7)"""

SQL = {
    "p9_matches": _P9_MATCHES,
    "p9_near": _P9_NEAR,
    "p9_found": _P9,
    "p7_percentiles": _P7,
    "p7_percentiles_from_days": _P7,
    "p3_found": f"WITH {_P3} SELECT * FROM f",
    "p3_share": f"""WITH {_P3}, r AS (SELECT read_id, max(length(basecall)) AS n FROM bas_reads WHERE read_id IS NOT NULL GROUP BY read_id),
t AS (SELECT read_id, sum(span_end - span_start) AS n, count(*) AS k FROM f GROUP BY read_id)
SELECT r.read_id, CAST(coalesce(r.n, 0) AS INTEGER) AS n_bases, CAST(coalesce(t.n, 0) AS BIGINT) AS n_shared, coalesce(t.k, 0) AS n_spans,
       CASE WHEN r.n > 0 THEN round(coalesce(t.n, 0) / r.n, 6) END AS share FROM r LEFT JOIN t ON r.read_id = t.read_id""",
    "p3_repeats": """WITH d AS (SELECT DISTINCT read_id, basecall FROM bas_reads WHERE length(basecall) >= 60 AND read_id IS NOT NULL),
k AS (SELECT read_id, p, substring(basecall, CAST(p AS BIGINT) + 1, 60) AS w FROM (SELECT read_id, basecall, unnest(range(length(basecall) - 59)) AS p FROM d)),
c AS (SELECT * FROM k WHERE regexp_full_match(w, '[ACGT]+')),
h AS (SELECT a.read_id, b.read_id AS other, a.p, b.p - a.p AS diagonal FROM c a JOIN c b ON a.w = b.w WHERE a.read_id < b.read_id OR (a.read_id = b.read_id AND a.p < b.p)),
r AS (SELECT *, p - row_number() OVER (PARTITION BY read_id, other, diagonal ORDER BY p) AS run FROM h),
m AS (SELECT read_id, min(p) AS p, max(p) - min(p) + 60 AS n FROM r GROUP BY read_id, other, diagonal, run),
t AS (SELECT DISTINCT substring(basecall, CAST(p AS BIGINT) + 1, CAST(n AS BIGINT)) AS t FROM m JOIN d USING (read_id))
SELECT md5(t) AS repeat, CAST(length(t) AS INTEGER) AS length, count(DISTINCT c.read_id) AS n_records, count(*) AS n_places
FROM t JOIN c ON substring(t, 1, 60) = c.w JOIN d ON c.read_id = d.read_id AND substring(d.basecall, CAST(c.p AS BIGINT) + 1, length(t)) = t GROUP BY t HAVING count(DISTINCT c.read_id) > 1""",
    "p4_found": f"WITH {_P4} SELECT read_id, first_base, last_base FROM e",
    "p4_events": f"WITH {_P4} SELECT * FROM e",
    "p5_found": """SELECT movie_id, hole_number, aln_id FROM (
  SELECT movie_id, hole_number, aln_id, row_number() OVER (PARTITION BY movie_id, hole_number ORDER BY map_qv DESC, aln_id) AS r
  FROM (SELECT DISTINCT movie_id, hole_number, aln_id, map_qv FROM alignment_index WHERE movie_id IS NOT NULL AND hole_number IS NOT NULL AND map_qv IS NOT NULL)
) WHERE r <= 3""",
}
