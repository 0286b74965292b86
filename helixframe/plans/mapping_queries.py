"""Chaining, alignment and mapping on reads and derived pairs. Searches take the reads with an id divisible by 100 against all reads."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import dp, seq
from helixframe.operators import mapping, seeds, simulate
from helixframe.plans.data import READS, reads
from helixframe.plans.relations import _mems
from helixframe.session import table
from helixframe.sources import formats

QUERIES, SQL = {}, {}
S = SparkSession
SCORES = dp.Scores.named("long_read", insertion=5, deletion=5)
AFFINE = dp.Scores.named("long_read", insertion=1, deletion=1, open=10)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _pairs(spark: S, d: str) -> DataFrame:
    """Each part's derived sequence with a changed copy: a stretch deleted, one inserted, letters replaced."""
    p = table(spark, d, "part").select("p_partkey", F.concat(seq.dna_from_key("p_partkey"), seq.dna_from_key(F.col("p_partkey") + 1)).alias("query"))
    changed = F.concat(F.substring("query", 1, 20), F.substring("query", 24, 17), F.lit("ACCA"), F.substring("query", 41, 8), F.lit("T"), F.substring("query", 50, 15))
    return p.withColumn("target", changed)


def _aligned(mode: str = "global", scores: dp.Scores = SCORES, **other):
    def f(spark: S, d: str) -> DataFrame:
        return mapping.align_pairs(_pairs(spark, d), scores, mode, **other).drop("query", "target")

    return f


QUERIES |= {
    "align_nw": _aligned(),
    "align_sw": _aligned("local"),
    "align_query_fit": _aligned("query_fit"),
    "align_overlap": _aligned("overlap"),
    "align_banded": _aligned(band=12),
    "align_affine": _aligned(scores=AFFINE),
    "align_affine_banded": _aligned(scores=dp.Scores.named("long_read", insertion=1, deletion=1, open=10, homopolymer_insertion=0), band=12),
    "align_long_gap": _aligned(scores=dp.Scores.named("long_read", insertion=4, deletion=4, long_open=20, long_ext=0)),
    "align_sdp": _aligned(method="sparse"),
    "align_one_gap": _aligned(method="one_gap"),
    "extend_xdrop": _aligned(method="extend"),
    "extend_xdrop_back": _aligned(method="extend_back"),
}


@query
def align_guided(spark: S, d: str) -> DataFrame:
    """Refinement: a sparse alignment's blocks guide an affine one with a narrow band."""
    rough = mapping.align_pairs(_pairs(spark, d), SCORES, method="sparse").select("p_partkey", "query", "target", "cigar")
    from helixframe.functions import cigar

    blocks = F.transform(cigar.blocks(cigar.operations("cigar")), lambda b: F.struct(b["q_pos"].alias("q"), b["t_pos"].alias("t"), b["length"].alias("length")))
    return mapping.align_pairs(rough.select("p_partkey", "query", "target", blocks.alias("guide")), AFFINE, "global", 8, "guide").drop("query", "target")


def edit_distance_userscore(spark: S, d: str) -> DataFrame:
    """Edit distance as an alignment under user scores."""
    p = _pairs(spark, d)
    done = mapping.align_pairs(p, dp.Scores.parse(" ".join("0" if i == j else "1" for i in range(5) for j in range(5)), insertion=1, deletion=1))
    return done.select("p_partkey", F.col("score").cast("long").alias("edits"))


QUERIES["edit_distance_userscore"] = edit_distance_userscore
_D = lambda k: f"translate(md5(CAST({k} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
SQL["edit_distance_userscore"] = f"""SELECT p_partkey, levenshtein(q, substring(q, 1, 20) || substring(q, 24, 17) || 'ACCA' || substring(q, 41, 8) || 'T' || substring(q, 50, 15)) AS edits
FROM (SELECT p_partkey, {_D('p_partkey')} || {_D('p_partkey + 1')} AS q FROM part)"""


@query
def chain_global(spark: S, d: str) -> DataFrame:
    found = mapping.chains(seeds.contiguous_groups(_mems(spark, d), 500))
    return found.drop("anchors")


@query
def chain_restricted(spark: S, d: str) -> DataFrame:
    return mapping.chains(seeds.contiguous_groups(_mems(spark, d), 500), max_gap=300, max_ratio=3.0).drop("anchors")


@query
def sdp_chain(spark: S, d: str) -> DataFrame:
    return mapping.chains(seeds.contiguous_groups(_mems(spark, d), 500), indel=0.5).drop("anchors")


@query
def chain_pvalues(spark: S, d: str) -> DataFrame:
    r = reads(spark, d).select("read_id", "seq")
    return mapping.with_log_p(mapping.chains(seeds.contiguous_groups(_mems(spark, d), 500)), r, "read_id", "seq", 10).drop("anchors")


PARAMS = mapping.MapParams(k=14, max_hits=50, max_score=-150, min_identity=65.0)


def _simulated(spark: S, d: str) -> DataFrame:
    """Reads with an id divisible by 100, with 5 % errors, every second one reverse-complemented."""
    r = simulate.mutate(reads(spark, d).where("read_id % 100 = 0"), "read_id", "seq", 0.02, 0.02, 0.01, seed=11)
    return r.select("read_id", F.when(F.expr("read_id div 100 % 2 = 1"), seq.reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"))


def _mapped(spark: S, d: str) -> DataFrame:
    return mapping.map_reads(_simulated(spark, d), reads(spark, d).select(F.col("read_id").alias("contig_id"), "seq"), PARAMS)


@query
def map_reads_e2e(spark: S, d: str) -> DataFrame:
    return _mapped(spark, d)


@query
def unaligned_reads(spark: S, d: str) -> DataFrame:
    """Reads without a hit of 96 % or more."""
    return mapping.unaligned(_simulated(spark, d), _mapped(spark, d).where("pct_similarity >= 96"))


@query
def map_reads_retry(spark: S, d: str) -> DataFrame:
    """Reads without a good hit are mapped again with shorter seeds."""
    contigs = reads(spark, d).select(F.col("read_id").alias("contig_id"), "seq")
    return mapping.map_with_retry(_simulated(spark, d), contigs, PARAMS, replace(PARAMS, k=11, max_hits=200), 96.0)


@query
def align_quality(spark: S, d: str) -> DataFrame:
    """Each read against a copy with errors, every letter's score multiplied by its quality value."""
    r = reads(spark, d).where("size(qual) = length(seq)").select("read_id", F.col("seq").alias("query"), "qual")
    changed = simulate.mutate(reads(spark, d), "read_id", "seq", 0.02, 0.02, 0.01, seed=5).select("read_id", F.col("seq").alias("target"))
    scores = dp.Scores.named("qv", insertion=20, deletion=20)
    return mapping.align_pairs(r.join(changed, "read_id"), scores, "global", 40, quality="qual").drop("query", "target", "qual")


def _per_pair(kernel, schema: str):
    """Anchors of each (query, target) pair, in order, handed to a kernel over their arrays q, t, length."""

    def f(spark: S, d: str) -> DataFrame:
        grouped = _mems(spark, d).groupBy("q_id", "t_id").agg(F.array_sort(F.collect_list(F.struct("q", "t", "length"))).alias("a"))

        def run(it):
            for batch in it:
                rows = [kernel(*(np.array([x[c] for x in a], np.int64) for c in ("q", "t", "length"))) for a in batch["a"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["q_id"], batch["t_id"], *(pa.array(c, pa.int32()) for c in zip(*rows))], ["q_id", "t_id", *schema.split()])

        return grouped.mapInArrow(run, "q_id bigint, t_id bigint, " + ", ".join(f"{c} int" for c in schema.split()))

    return f


def _increasing(q, t, length) -> tuple[int, int]:
    """Anchors whose target places rise with the query's, as many as can be; their bases."""
    kept = dp.longest_increasing(t.tolist())
    return len(kept), int(length[kept].sum()) if len(kept) else 0


def _coarse(q, t, length) -> tuple[int, int]:
    """Anchors that a path of 64-letter cells keeps; their bases."""
    kept = np.asarray(dp.coarse_chain(q, t, 64), bool)
    return int(kept.sum()), int(length[kept].sum())


QUERIES |= {"lis_anchors": _per_pair(_increasing, "n_anchors bases"), "coarse_chain": _per_pair(_coarse, "n_anchors bases")}


def _three(spark: S, d: str) -> DataFrame:
    """Each supplier's three derived sequences of ten letters."""
    part = lambda n: F.substring(seq.dna_from_key(F.col("s_suppkey") + n), 1, 10).alias(f"s{n}")
    return table(spark, d, "supplier").select("s_suppkey", part(0), part(1), part(2))


@query
def align_three_way(spark: S, d: str) -> DataFrame:
    scores = dp.Scores.named("edit", deletion=1)

    def run(it):
        for batch in it:
            triples = list(zip(*(batch[f"s{n}"].to_pylist() for n in range(3))))
            known = [i for i, x in enumerate(triples) if None not in x]
            found: list[int | None] = [None] * len(triples)
            for i, score in zip(known, dp.three_way_many([triples[i] for i in known], scores)):
                found[i] = score
            yield pa.RecordBatch.from_arrays([batch["s_suppkey"], pa.array(found, pa.int32())], ["s_suppkey", "score"])

    # Suppliers lie in few files: they are spread evenly first.
    rows = _three(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(run, f"s_suppkey {rows.schema['s_suppkey'].dataType.simpleString()}, score int")


@query
def align_all_paths(spark: S, d: str) -> DataFrame:
    """log10 of the summed probability of all alignments of two sequences, at quality 12."""

    def run(it):
        for batch in it:
            found = [round(dp.forward_probability(a, np.full(len(a), 12), b), 6) for a, b in zip(batch["s0"].to_pylist(), batch["s1"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["s_suppkey"], pa.array(found, pa.float64())], ["s_suppkey", "log_p"])

    rows = _three(spark, d)
    return rows.mapInArrow(run, f"s_suppkey {rows.schema['s_suppkey'].dataType.simpleString()}, log_p double")


def _records(spark: S, d: str) -> DataFrame:
    """Each read of more than 40 letters, placed on itself without its first five and last seven; every second one turned."""
    r = reads(spark, d).where("length(seq) > 40 and read_name is not null")
    n = F.length("seq")
    merge = table(spark, d, "bas_reads").where("read_id is not null and length(basecall) > 0").dropDuplicates(["read_id"]).select("read_id", "merge_qv")
    return r.join(merge, "read_id").select(
        F.col("read_name").alias("q_name"), F.lit("ref").alias("t_name"), "seq", "qual", "merge_qv", n.alias("q_length"), F.lit(5).alias("q_start"), (n - 7).alias("q_end"), F.lit(10).alias("t_start"), (n - 2).alias("t_end"),
        (F.col("read_id") % 2).alias("strand"), F.lit(True).alias("is_primary"), F.concat((n - 12).cast("string"), F.lit("=")).alias("cigar"), (-5 * (n - 12)).alias("score"), F.lit(254).alias("map_qv"),
        *(F.lit(0).alias(c) for c in ("n_mismatch", "n_ins", "n_del")), F.concat(F.lit("rq:f:"), F.round("rq", 2).cast("string")).alias("rq_tag"),
    )


_LETTERS = "array_to_string(list_transform({}, lambda x: chr(greatest(least(coalesce(x, 0), 93), 0) + 33)), '')"


def _sam_sql(clipping: str) -> str:
    """The same records; what is soft-clipped keeps all bases."""
    first, last = ("1", "n") if clipping == "soft" else ("6", "n - 7")
    cut_out = lambda x: f"array_slice({x}, {first}, {last})"
    turned = lambda c: f"CASE WHEN len({c}) = n THEN {_LETTERS.format(cut_out(f'CASE WHEN strand = 1 THEN list_reverse({c}) ELSE {c} END'))} END"
    bases = f"array_to_string({cut_out('string_split(CASE WHEN strand = 1 THEN translate(reverse(seq), {a}, {b}) ELSE seq END, {e})'.format(a=chr(39) + 'ACGT' + chr(39), b=chr(39) + 'TGCA' + chr(39), e=chr(39) * 2))}, '')"
    cigar = {"soft": "'5S' || (n - 12) || '=7S'", "hard": "'5H' || (n - 12) || '=7H'"}.get(clipping, "(n - 12) || '='")
    return f"""WITH {READS}, m AS (SELECT read_id, any_value(merge_qv) AS merge_qv FROM bas_reads WHERE read_id IS NOT NULL AND length(basecall) > 0 GROUP BY read_id),
r AS (SELECT reads.*, merge_qv, length(seq) AS n, read_id % 2 AS strand FROM reads JOIN m USING (read_id) WHERE length(seq) > 40 AND read_name IS NOT NULL)
SELECT concat_ws('\t', read_name, CASE WHEN strand = 1 THEN '16' ELSE '0' END, 'ref', '11', '254', {cigar}, '*', '0', n - 12, {bases}, coalesce({turned('qual')}, '*'),
  'RG:Z:' || substring(md5(split_part(read_name, '/', 1)), 1, 10), 'AS:i:' || (-5 * (n - 12)), 'XS:i:6', 'XE:i:' || (n - 6), 'XL:i:' || (n - 12), 'NM:i:0', 'XT:i:1', 'mq:Z:' || {turned('merge_qv')}) AS line FROM r"""


for _how in ("soft", "hard", "subread"):
    QUERIES[f"sam_qualities_{_how}"] = lambda spark, d, how=_how: formats.sam_body(_records(spark, d), how, "qual", {"mq": "merge_qv"})
    SQL[f"sam_qualities_{_how}"] = _sam_sql(_how)


def _named(spark: S, d: str) -> DataFrame:
    names = reads(spark, d).select("read_id", "read_name", "seq")
    queries = _simulated(spark, d).join(names.select("read_id", F.col("read_name").alias("q_name")), "read_id")
    return _mapped(spark, d).join(queries, "read_id").join(names.select(F.col("read_id").alias("contig_id"), F.col("read_name").alias("t_name"), F.col("seq").alias("t_seq")), "contig_id")


def _with_strings(spark: S, d: str) -> DataFrame:
    """Gapped strings from the CIGAR, without a second alignment."""
    from helixframe.functions import cigar

    n = _named(spark, d).withColumn("qa", F.when(F.col("strand") == 1, seq.reverse_complement("seq")).otherwise(F.col("seq")))
    start = F.struct(F.col("q_start").alias("q"), F.col("t_start").alias("t"), F.lit("").alias("a"), F.lit("").alias("k"), F.lit("").alias("b"))

    def step(s, o):
        on_q, on_t, k = o["op"] != "D", o["op"] != "I", o["len"]
        gap = F.repeat(F.lit("-"), k)
        return F.struct(
            (s["q"] + F.when(on_q, k).otherwise(0)).alias("q"), (s["t"] + F.when(on_t, k).otherwise(0)).alias("t"),
            F.concat(s["a"], F.when(on_q, F.substring(F.col("qa"), s["q"] + 1, k)).otherwise(gap)).alias("a"),
            F.concat(s["k"], F.repeat(F.when(o["op"] == "=", "|").otherwise(" "), k)).alias("k"),
            F.concat(s["b"], F.when(on_t, F.substring(F.col("t_seq"), s["t"] + 1, k)).otherwise(gap)).alias("b"),
        )

    n = n.withColumn("_x", F.aggregate(cigar.operations("cigar"), start, step))
    return n.select("*", F.col("_x.a").alias("q_string"), F.col("_x.k").alias("ticks"), F.col("_x.b").alias("t_string")).drop("_x", "qa", "t_seq")


QUERIES |= {
    "sam_text": lambda spark, d: formats.sam_body(_named(spark, d)),
    "m0_stick": lambda spark, d: formats.m0_stick(_with_strings(spark, d)),
    "m1_summary": lambda spark, d: formats.m1(_named(spark, d)),
    "m2_xml": lambda spark, d: formats.m2_xml(_with_strings(spark, d)),
    "m3_vulgar": lambda spark, d: formats.m3_vulgar(_named(spark, d)),
    "m4_interval": lambda spark, d: formats.m4(_named(spark, d)),
    "m5_compare": lambda spark, d: formats.m5(_with_strings(spark, d)),
}


@query
def sam_header(spark: S, d: str) -> DataFrame:
    contigs = table(spark, d, "ref_info").select(F.col("ref_name").alias("t_name"), F.col("ref_length").alias("t_length"), "md5")
    return formats.sam_header(contigs, table(spark, d, "movie_info")).select("line")


SQL["sam_header"] = """SELECT '@HD\tVN:1.5\tSO:unknown' AS line UNION ALL SELECT '@SQ\tSN:' || ref_name || '\tLN:' || ref_length || CASE WHEN md5 IS NOT NULL THEN '\tM5:' || md5 ELSE '' END FROM ref_info
UNION ALL SELECT '@RG\tID:' || substring(md5(movie_name), 1, 10) || '\tPU:' || movie_name FROM movie_info WHERE movie_name IS NOT NULL UNION ALL SELECT '@PG\tID:helixframe\tPN:helixframe'"""


@query
def adapter_screen(spark: S, d: str) -> DataFrame:
    """The best place of either of two adapters in each read, by local alignment; the adapters are parameters."""
    adapters = ["ATCTCTCTCTTTTCCTCCTCCTCCGTTGTTGTTGTTGAGAGAGAT", "ACACTCTTTCCCTACACGACGCTCTTCCGATCT"]
    r = reads(spark, d).select("read_id", F.col("seq").alias("target"), F.explode(F.array(*(F.lit(a) for a in adapters))).alias("query"))
    done = mapping.align_pairs(r, SCORES, "local").where("score <= -40")
    return done.groupBy("read_id").agg(F.min_by(F.struct("query", "score", "t_start", "t_end"), F.struct("score", "query")).alias("x")).select("read_id", "x.*")
