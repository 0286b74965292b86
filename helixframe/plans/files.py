"""Readers and writers: the test tables written in each text format and read back from there."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.data import ALIGNMENTS, READS, alignments, reads
from helixframe.session import checkpoint_dir, table
from helixframe.sources import readers

QUERIES, SQL = {}, {}
S = SparkSession


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _folder(spark: S) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark)}/files-{uuid4().hex}"


def _written(lines: DataFrame) -> str:
    path = _folder(lines.sparkSession)
    readers.write_lines(lines, path)
    return path


@query(f"WITH {READS} SELECT read_name AS title, seq, length(seq) AS length, md5(seq) AS md5 FROM reads WHERE read_name IS NOT NULL")
def fasta_scan(spark: S, d: str) -> DataFrame:
    path = _folder(spark)
    readers.write_fasta(reads(spark, d), path, "read_name", "seq")
    return readers.read_fasta(spark, path).drop("name")


_QUAL = "array_to_string(list_transform(qual[1:length(seq)], lambda x: coalesce(x, 0)), ',')"


@query(f"WITH {READS} SELECT read_name AS title, seq, {_QUAL} AS qual FROM reads WHERE read_name IS NOT NULL AND len(qual) >= length(seq)")
def fastq_scan(spark: S, d: str) -> DataFrame:
    """Small splits, so that one file is read by many tasks."""
    path = _folder(spark)
    readers.write_fastq(reads(spark, d).where("size(qual) >= length(seq)").withColumn("qual", F.expr("slice(qual, 1, length(seq))")), path, "read_name", "seq", "qual")
    return readers.read_fastq(spark, path, split=100_000).select("title", "seq", F.array_join("qual", ",").alias("qual"))


# Columns of alignment formats from the alignments, by expressions that both dialects know.
_BASES = "coalesce(n_m, 0) + coalesce(n_mm, 0) + coalesce(n_ins, 0) + coalesce(n_del, 0)"
_OF = {
    "qname": "concat('hole', coalesce(hole_number, 0), '/', aln_id)", "tname": "concat('ref', ref_seq_id)", "score": "-5 * coalesce(n_m, 0)", "cluster_weight": "CAST(coalesce(n_m, 0) AS DOUBLE)",
    "pct_similarity": f"round(CAST(100 AS DOUBLE) * coalesce(n_m, 0) / ({_BASES} + 1), 4)", "qstrand": "0", "tstrand": "CAST(coalesce(rc_ref_strand, 0) AS INTEGER)",
    "tstart": "t_start", "tend": "t_end", "tlen": "CAST(t_end + 100 AS BIGINT)", "qstart": "CAST(coalesce(r_start, 0) AS BIGINT)", "qend": "CAST(coalesce(r_end, 0) AS BIGINT)", "qlen": "CAST(coalesce(r_end, 0) + 7 AS BIGINT)",
    "mapqv": "CAST(coalesce(map_qv, 0) AS INTEGER)", "n_match": "coalesce(n_m, 0)", "n_mismatch": "coalesce(n_mm, 0)", "n_ins": "coalesce(n_ins, 0)", "n_del": "coalesce(n_del, 0)",
    "q_aln": "'AC-GT'", "ticks": "'|| ||'", "t_aln": "'ACGGT'",
}


def _columns(schema: str, **other: str) -> dict[str, str]:
    return {n: (_OF | other)[n] for n in (x.split()[0] for x in schema.split(", "))}


_SIGN = {"qstrand": "'+'", "tstrand": "CASE WHEN rc_ref_strand = 1 THEN '-' ELSE '+' END"}
_RM4 = {"pct_identity": _OF["pct_similarity"], "qbegin": _OF["qstart"], "tbegin": _OF["tstart"]}
_SAM = {
    "flag": "CASE WHEN rc_ref_strand = 1 THEN 16 ELSE 0 END", "rname": _OF["tname"], "pos": "t_start + 1", "mapq": _OF["mapqv"], "cigar": "concat(coalesce(n_m, 0) + 1, 'M')", "rnext": "'*'",
    "pnext": "CAST(0 AS BIGINT)", "tlen": "CAST(t_end - t_start AS INTEGER)", "seq": "'*'", "qual": "'*'",
}
_REGION = {"chr": _OF["tname"], "start": "t_start", "end": "t_end"}
FORMATS = {
    "m1_scan": (readers.read_m1, _columns(readers.M1_SCHEMA), " "),
    "m4_scan": (readers.read_m4, _columns(readers.M4_SCHEMA), " "),
    "m5_scan": (readers.read_m5, _columns(readers.M5_SCHEMA, **_SIGN), " "),
    "rm4_scan": (readers.read_rm4, _columns(readers.RM4_SCHEMA, **_RM4), " "),
    "region_scan": (readers.read_regions, _REGION, "\t"),
}


def _scan(name: str):
    def f(spark: S, d: str) -> DataFrame:
        read, columns, sep = FORMATS[name]
        lines = alignments(spark, d).select(F.concat_ws(sep, *(F.translate(F.expr(x).cast("string"), " ", "*") if n == "ticks" else F.expr(x).cast("string") for n, x in columns.items())).alias("line"))
        return read(spark, _written(lines))

    return f


for _name, (_, _cols, _) in FORMATS.items():
    QUERIES[_name] = _scan(_name)
    SQL[_name] = f"WITH {ALIGNMENTS} SELECT {', '.join(f'{x} AS {chr(34)}{n}{chr(34)}' for n, x in _cols.items())} FROM alns"


@query(f"WITH {ALIGNMENTS} SELECT {_OF['qname']} AS qname, {', '.join(f'{x} AS {n}' for n, x in _SAM.items())}, CAST(coalesce(n_mm, 0) AS VARCHAR) AS nm, concat('m', movie_id) AS rg FROM alns")
def sam_scan(spark: S, d: str) -> DataFrame:
    """Alignment records with two tags; the header lines before them are left out."""
    fields = [_OF["qname"], *_SAM.values(), "concat('NM:i:', coalesce(n_mm, 0))", "concat('RG:Z:m', movie_id)"]
    body = alignments(spark, d).select(F.concat_ws("\t", *(F.expr(x).cast("string") for x in fields)).alias("line"))
    head = table(spark, d, "ref_info").select(F.concat(F.lit("@SQ\tSN:ref"), "ref_seq_id", F.lit("\tLN:"), "ref_length").alias("line"))
    found = readers.read_sam(spark, _written(head.unionByName(body)))
    return found.select(*(c for c in found.columns if c != "tags"), F.col("tags")["NM"].alias("nm"), F.col("tags")["RG"].alias("rg"))


@query("SELECT 'SQ' AS kind, concat('ref', ref_seq_id) AS name, CAST(ref_length AS VARCHAR) AS length FROM ref_info")
def sam_header_scan(spark: S, d: str) -> DataFrame:
    head = table(spark, d, "ref_info").select(F.concat(F.lit("@SQ\tSN:ref"), "ref_seq_id", F.lit("\tLN:"), "ref_length").alias("line"))
    return readers.read_sam_header(spark, _written(head)).select("kind", F.col("fields")["SN"].alias("name"), F.col("fields")["LN"].alias("length"))


@query(f"WITH {ALIGNMENTS} SELECT concat('chr', ref_seq_id) AS chr, 'exon' AS type, t_start + 1 AS start, t_end AS \"end\", CASE WHEN rc_ref_strand = 1 THEN '-' ELSE '+' END AS strand, concat('G', ref_seq_id) AS gene_id, concat('T', aln_id) AS transcript_id, CAST(2 AS INTEGER) AS level FROM alns")
def gtf_scan(spark: S, d: str) -> DataFrame:
    attributes = F.expr("concat('gene_id \"G', ref_seq_id, '\"; transcript_id \"T', aln_id, '\"; level 2;')")
    strand = F.expr("CASE WHEN rc_ref_strand = 1 THEN '-' ELSE '+' END")
    lines = alignments(spark, d).select(F.concat_ws("\t", F.expr("concat('chr', ref_seq_id)"), F.lit("test"), F.lit("exon"), F.expr("t_start + 1").cast("string"), F.col("t_end").cast("string"), F.lit("."), strand, F.lit("."), attributes).alias("line"))
    return readers.read_gtf(spark, _written(lines)).select("chr", "type", "start", "end", "strand", "gene_id", "transcript_id", "level")


@query(f"WITH {ALIGNMENTS} SELECT CAST(coalesce(n_m, 0) AS INTEGER) AS sw_score, concat('ref', ref_seq_id) AS query, t_start AS start, t_end AS \"end\", t_end + 5 AS \"left\", 'AluY' AS repeat, CAST(coalesce(r_start, 0) AS INTEGER) AS r_start FROM alns")
def repeatmasker_scan(spark: S, d: str) -> DataFrame:
    fields = ["coalesce(n_m, 0)", "1.5", "0.2", "0.1", "concat('ref', ref_seq_id)", "t_start", "t_end", "concat('(', t_end + 5, ')')", "'C'", "'AluY'", "'SINE/Alu'", "coalesce(r_start, 0)", "coalesce(r_end, 0)", "'(3)'", "1"]
    lines = alignments(spark, d).select(F.concat_ws("  ", *(F.expr(x).cast("string") for x in fields)).alias("line"))
    head = spark.createDataFrame([("   SW  perc perc perc  query",), ("score  div. del. ins.  sequence",), ("",)], "line string")
    return readers.read_repeatmasker(spark, _written(head.unionByName(lines))).select("sw_score", "query", "start", "end", "left", "repeat", "r_start")


@query(f"WITH {READS} SELECT read_name AS name, seq FROM reads WHERE read_name IS NOT NULL")
def file_list_scan(spark: S, d: str) -> DataFrame:
    """Reads spread over two files that a list of files names, loaded by the list's format."""
    base = _folder(spark)
    for part in (0, 1):
        readers.write_fasta(reads(spark, d).where(F.col("read_id") % 2 == part), f"{base}/{part}.fasta", "read_name", "seq")
    readers.write_lines(spark.createDataFrame([(f"{base}/{p}.fasta",) for p in (0, 1)], "line string"), f"{base}/all.fofn")
    return readers.load_reads(spark, f"{base}/all.fofn")


@query(f"WITH {READS} SELECT read_name AS title FROM (SELECT read_name, row_number() OVER (ORDER BY read_id) AS n FROM reads WHERE read_name IS NOT NULL) WHERE n > 25")
def skip_first_reads(spark: S, d: str) -> DataFrame:
    from helixframe.sources.scan import skip

    return skip(reads(spark, d).where("read_name is not null").select("read_id", F.col("read_name").alias("title")), "read_id", 25).select("title")
