"""Graphs, simulation and event windows on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.operators import graph, simulate
from helixframe.plans.data import READS, reads
from helixframe.session import table
from helixframe.sources import scan
from helixframe.streaming import events

QUERIES, SQL = {}, {}
S = SparkSession


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_EDGES = "e AS (SELECT src, dst, count(*) AS n FROM (SELECT lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS src, l_suppkey AS dst FROM lineitem) WHERE src IS NOT NULL GROUP BY ALL)"


def _edges(spark: S, d: str) -> DataFrame:
    pairs = graph.consecutive_pairs(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey", ["l_linenumber", "l_suppkey"], "l_suppkey")
    return graph.edges_from_overlaps(pairs, "src", "dst")


@query(f"WITH {_EDGES} SELECT * FROM e")
def overlap_graph_edges(spark: S, d: str) -> DataFrame:
    return _edges(spark, d)


@query("SELECT src, dst, count(*) AS n FROM (SELECT 2 * s AS src, 2 * d AS dst FROM p UNION ALL SELECT 2 * d + 1, 2 * s + 1 FROM p) GROUP BY ALL".replace("FROM p ", "FROM (SELECT lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS s, l_suppkey AS d FROM lineitem) WHERE s IS NOT NULL ").replace("FROM p)", "FROM (SELECT lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS s, l_suppkey AS d FROM lineitem) WHERE s IS NOT NULL)"))
def repeat_graph_two_strands(spark: S, d: str) -> DataFrame:
    pairs = graph.consecutive_pairs(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey", ["l_linenumber", "l_suppkey"], "l_suppkey")
    return graph.edges_from_overlaps(pairs, "src", "dst", both_strands=True)


@query(f"WITH {_EDGES} SELECT * FROM e WHERE n >= 8")
def low_coverage_edges(spark: S, d: str) -> DataFrame:
    return graph.drop_low_coverage(_edges(spark, d), 8)


_SPARSE = "s AS (SELECT DISTINCT p_partkey AS src, p_partkey + p_size % 5 + 1 AS dst, CAST(1 AS BIGINT) AS n FROM part UNION SELECT p_partkey, p_partkey + 2, 1 FROM part WHERE p_size % 3 = 0)"


def _sparse(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part")
    one = p.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size") % 5 + 1).alias("dst"))
    return one.unionByName(p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 2).alias("dst"))).distinct().withColumn("n", F.lit(1).cast("long"))


@query(f"WITH {_SPARSE} SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s a JOIN s b ON a.dst = b.src WHERE a.src = s.src AND b.dst = s.dst AND a.src <> a.dst AND b.src <> b.dst)")
def transitive_reduction(spark: S, d: str) -> DataFrame:
    return graph.transitive_reduction(_sparse(spark, d), 2)


@query(f"""WITH {_SPARSE}, i AS (SELECT dst AS v, count(*) AS n FROM s GROUP BY dst), o AS (SELECT src AS v, count(*) AS n FROM s GROUP BY src)
SELECT s.* FROM s LEFT JOIN i si ON s.src = si.v LEFT JOIN i di ON s.dst = di.v LEFT JOIN o so ON s.src = so.v LEFT JOIN o dd ON s.dst = dd.v
WHERE NOT ((si.n IS NULL AND di.n > 1) OR (dd.n IS NULL AND so.n > 1))""")
def tip_trim(spark: S, d: str) -> DataFrame:
    return graph.trim_tips(_sparse(spark, d))


_CHAINS = "s AS (SELECT p_partkey AS src, p_partkey + 1 AS dst, CAST(1 AS BIGINT) AS n FROM part WHERE p_partkey % 40 <> 0 AND p_size <> 7)"


def _chains(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_partkey % 40 <> 0 and p_size <> 7").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.lit(1).cast("long").alias("n"))


@query(f"""WITH RECURSIVE {_CHAINS}, v AS (SELECT src AS v FROM s UNION SELECT dst FROM s), r AS (SELECT v, v AS c FROM v UNION SELECT s.dst, r.c FROM r JOIN s ON r.v = s.src)
SELECT v, min(c) AS component FROM r GROUP BY v""")
def connected_components(spark: S, d: str) -> DataFrame:
    return graph.connected_components(_chains(spark, d))


@query(f"""WITH RECURSIVE {_CHAINS}, v AS (SELECT src AS v FROM s UNION SELECT dst FROM s), r AS (SELECT v, v AS path, 0 AS place FROM v WHERE v NOT IN (SELECT dst FROM s) UNION ALL SELECT s.dst, r.path, r.place + 1 FROM r JOIN s ON r.v = s.src)
SELECT v, path, CAST(place AS INTEGER) AS place FROM r""")
def simple_paths(spark: S, d: str) -> DataFrame:
    return graph.simple_paths(_chains(spark, d))


@query(f"WITH {_EDGES}, i AS (SELECT dst AS v, sum(n) AS n FROM e GROUP BY dst), o AS (SELECT src AS v, sum(n) AS n FROM e GROUP BY src) SELECT coalesce(i.v, o.v) AS v, CAST(coalesce(i.n, 0) AS BIGINT) AS n_in, CAST(coalesce(o.n, 0) AS BIGINT) AS n_out, CAST(coalesce(o.n, 0) - coalesce(i.n, 0) AS BIGINT) AS surplus FROM i FULL JOIN o ON i.v = o.v")
def graph_flow(spark: S, d: str) -> DataFrame:
    return graph.flow_balance(_edges(spark, d))


@query(f"WITH {_EDGES} SELECT '  ' || src || ' -> ' || dst || ' [label=\"' || n || '\"];' AS line FROM e")
def graph_dot(spark: S, d: str) -> DataFrame:
    return graph.dot_lines(_edges(spark, d))


# simulation


@query(f"WITH {READS} SELECT read_id, CAST(s AS INTEGER) AS start, substring(seq, CAST(s AS BIGINT) + 1, 120) AS tile FROM (SELECT read_id, seq, unnest(range(0, length(seq), 40)) AS s FROM reads)")
def tile_genome(spark: S, d: str) -> DataFrame:
    return simulate.tiles(reads(spark, d), "read_id", "seq", 120, 40)


@query(f"WITH {READS} SELECT read_id, CAST(s AS INTEGER) AS start, substring(seq, CAST(s AS BIGINT) + 1, 200) AS tile FROM (SELECT read_id, seq, unnest(range(0, length(seq), 200)) AS s FROM reads)")
def split_contigs(spark: S, d: str) -> DataFrame:
    return simulate.split_pieces(reads(spark, d), "read_id", "seq", 200)


@query()
def shred_reads(spark: S, d: str) -> DataFrame:
    return simulate.shred(reads(spark, d), "read_id", "seq", 2.0, 150, seed=7)


@query()
def mutate_reads(spark: S, d: str) -> DataFrame:
    m = simulate.mutate(reads(spark, d), "read_id", "seq", 0.02, 0.02, 0.01, seed=7)
    return m.select("read_id", "seq", F.size("changes").alias("n_changes"))


@query()
def gc_normalise(spark: S, d: str) -> DataFrame:
    return simulate.gc_normalised(reads(spark, d), "read_id", "seq", 0.4, seed=7)


@query("SELECT a.n_name AS first, b.n_name AS second, a.s || b.s AS seq FROM (SELECT n_name, substring(translate(md5(n_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 16) AS s FROM nation) a, (SELECT n_name, substring(translate(md5(n_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 16) AS s FROM nation) b WHERE a.n_name <> b.n_name")
def barcode_database(spark: S, d: str) -> DataFrame:
    return simulate.barcode_pairs(table(spark, d, "nation").select("n_name", F.substring(seq.dna_from_key("n_name"), 1, 16).alias("s")), "n_name", "s")


_PAIRS = f"WITH {READS}, p AS (SELECT substring(seq, CAST(i AS BIGINT), 3) AS c, substring(seq, CAST(i AS BIGINT) + 3, 1) AS o FROM (SELECT seq, unnest(range(1, length(seq) - 2)) AS i FROM reads))"


def _contexts(spark: S, d: str) -> DataFrame:
    r = reads(spark, d).where("length(seq) > 3").select("seq", F.explode(F.expr("sequence(1, length(seq) - 3)")).alias("i"))
    return r.select(F.expr("substring(seq, i, 3)").alias("c"), F.expr("substring(seq, i + 3, 1)").alias("o"))


@query(f"{_PAIRS}, n AS (SELECT c AS context, o AS outcome, count(*) AS n FROM p GROUP BY ALL) SELECT context, outcome, n, round(n / sum(n) OVER (PARTITION BY context), 6) AS share, round(sum(n) OVER (PARTITION BY context ORDER BY outcome) / sum(n) OVER (PARTITION BY context), 6) AS upto FROM n")
def context_model(spark: S, d: str) -> DataFrame:
    return simulate.context_model(_contexts(spark, d), "c", "o")


@query()
def context_draws(spark: S, d: str) -> DataFrame:
    starts = reads(spark, d).select("read_id", F.substring("seq", 1, 3).alias("c"))
    return simulate.draw_outcomes(starts, "read_id", "c", simulate.context_model(_contexts(spark, d), "c", "o"), seed=3)


@query(f"WITH {READS}, n AS (SELECT CAST(length(seq) AS INTEGER) AS length, count(*) AS n FROM reads GROUP BY ALL) SELECT length, n, round(sum(n) OVER (ORDER BY length) / (SELECT sum(n) FROM n), 6) AS upto FROM n")
def length_histogram(spark: S, d: str) -> DataFrame:
    return simulate.length_cdf(reads(spark, d).select(F.length("seq").alias("l")), "l")


@query()
def subsample_bernoulli(spark: S, d: str) -> DataFrame:
    return scan.subsample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 0.1, seed=5)


@query()
def shuffle_rows(spark: S, d: str) -> DataFrame:
    return scan.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", seed=5)


# event windows


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_tumbling(spark: S, d: str) -> DataFrame:
    return _plain(events.window_counts(table(spark, d, "events"), "ts", ["event_type"], "1 hour", value="value"))


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))


@query("SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL")
def event_sliding(spark: S, d: str) -> DataFrame:
    return _plain(events.window_counts(table(spark, d, "events"), "ts", ["event_type"], "2 hours", "1 hour"))


@query("""WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS f FROM events), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, s""")
def event_session(spark: S, d: str) -> DataFrame:
    return _plain(events.sessions(table(spark, d, "events"), "ts", ["user_id"], "12 hours"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup_watermark(spark: S, d: str) -> DataFrame:
    return events.deduplicated(table(spark, d, "events"), "ts", ["user_id", "event_type"]).select("user_id", "event_type")


@query()
def stream_seed_counts(spark: S, d: str) -> DataFrame:
    """The stateless mapper on stored reads: reads with an id divisible by 100 as the index, all reads searched."""
    r = reads(spark, d).select("read_id", "seq")
    return events.stream_seed_counts(r, r.where("read_id % 100 = 0").select(F.col("read_id").alias("contig_id"), "seq"), 16)
