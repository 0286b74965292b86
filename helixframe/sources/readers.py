"""Readers of sequence, alignment and annotation files into typed tables; nothing is collected and files are split where the format allows."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.seq import base_title
from helixframe.sources.scan import expand_fofn

SAM_SCHEMA = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string"
M1_SCHEMA = "qname string, tname string, qstrand int, tstrand int, score int, pct_similarity double, tstart long, tend long, tlen long, qstart long, qend long, qlen long, cluster_weight double"
M4_SCHEMA = "qname string, tname string, score int, pct_similarity double, qstrand int, qstart long, qend long, qlen long, tstrand int, tstart long, tend long, tlen long, mapqv int"
M5_SCHEMA = "qname string, qlen long, qstart long, qend long, qstrand string, tname string, tlen long, tstart long, tend long, tstrand string, score int, n_match int, n_mismatch int, n_ins int, n_del int, mapqv int, q_aln string, ticks string, t_aln string"
RM4_SCHEMA = "qname string, tname string, score int, pct_identity double, qstrand int, qbegin long, qend long, qlen long, tstrand int, tbegin long, tend long, tlen long"


def _paths(spark: SparkSession, path: str | list[str]) -> list[str]:
    return [q for p in ([path] if isinstance(path, str) else path) for q in expand_fofn(spark, p)]


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(name, title, seq, length, md5)``: records begin at ``>``; sequence lines are joined, carriage returns and blanks dropped."""
    raw = spark.read.option("lineSep", "\n>").text(_paths(spark, path)).where("length(trim(value)) > 0")
    text = F.regexp_replace("value", r"^>", "")
    title = F.rtrim(F.regexp_extract(text, r"^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s", "")
    return raw.select(base_title(title).alias("name"), title.alias("title"), seq.alias("seq")).select("*", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("md5"))


#: Bytes looked at to find where the first record of a split begins.
_SYNC = 1 << 20


def _fastq_splits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that begin within the splits (path, start, end) of files, some thousand at a time."""
    for batch in it:
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_file(name) as f:
                at = _first_record(f, start, _SYNC) if start else 0
                f.seek(at)
                lines = io.BufferedReader(f, 1 << 20)
                rows: list[tuple[str, str, str]] = []
                while at < end:
                    record = [lines.readline() for _ in range(4)]
                    if not record[0]:
                        break
                    at += sum(map(len, record))
                    if not record[0].strip():  # blank lines at the end
                        continue
                    title, seq, _, qual = (x.decode("utf-8", "replace").rstrip("\r\n") for x in record)
                    rows.append((title[1:], seq, qual))
                    if len(rows) >= 2000:
                        yield _fastq_batch(rows)
                        rows = []
                if rows:
                    yield _fastq_batch(rows)


def _fastq_batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["title", "seq", "q"])


def _first_record(f, start: int, size: int) -> int:
    """Where the first record at or after ``start`` begins: a line with ``@`` whose next but one has ``+`` and whose sequence and quality
    are equally long (a quality line may begin with ``@`` too). More is read until it is found or the file ends."""
    while True:
        f.seek(start - 1)
        data = f.read(size)
        at = data.find(b"\n") + 1
        whole = len(data) < size
        lines, places = [], []
        while at and at < len(data):
            end = data.find(b"\n", at)
            if end < 0 and not whole:
                break
            end = len(data) if end < 0 else end
            lines.append(data[at:end].rstrip(b"\r"))
            places.append(start - 1 + at)
            at = end + 1
        for i in range(len(lines) - 3):
            if lines[i][:1] == b"@" and lines[i + 2][:1] == b"+" and len(lines[i + 1]) == len(lines[i + 3]):
                return places[i]
        if whole:
            return start - 1 + len(data)
        size *= 4


def read_fastq(spark: SparkSession, path: str | list[str], split: int = 64 << 20) -> DataFrame:
    """``(name, title, seq, qual)`` of four-line records; qualities are the codes less 33.

    A file is read in splits of ``split`` bytes, each by a task of its own, that begin at a record: a quality line beginning with ``@``
    is told from one by what follows. A record whose quality is missing has an empty one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_paths(spark, path)).select("path", "length").where("length > 0")
    splits = files.select("path", F.explode(F.expr(f"sequence(0L, length - 1, {split}L)")).alias("start")).select("path", "start", (F.col("start") + split).alias("end"))
    rows = splits.repartition(F.col("path"), F.col("start")).mapInArrow(_fastq_splits, "title string, seq string, q string")
    qual = F.transform(F.filter(F.split("q", ""), lambda x: x != ""), lambda x: (F.ascii(x) - 33).cast("smallint"))
    return rows.select(base_title(F.col("title")).alias("name"), "title", "seq", qual.alias("qual"))


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignment records: the eleven fields and ``tags`` (name -> value); header lines are left out. A ``*`` stays as it is."""
    f = F.split("value", "\t")
    lines = spark.read.text(_paths(spark, path)).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    fields = [x.split() for x in SAM_SCHEMA.split(", ")]
    tags = F.transform(F.filter(F.slice(f, 12, 1 << 20), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 6, 1 << 20).alias("value")))
    return lines.select(*(f[i].try_cast(t).alias(n) for i, (n, t) in enumerate(fields)), F.map_from_entries(tags).alias("tags"))


def read_sam_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(kind, fields)`` of the header lines, e.g. kind ``SQ`` with SN and LN."""
    lines = spark.read.text(_paths(spark, path)).where(F.col("value").rlike("^@[A-Z]{2}\t"))
    pairs = F.transform(F.slice(F.split("value", "\t"), 2, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 4, 1 << 20).alias("value")))
    return lines.select(F.substring("value", 2, 2).alias("kind"), F.map_from_entries(pairs).alias("fields"))


def _delimited(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Fields parted by white space; lines with fewer fields give nulls at the end."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(_paths(spark, path)).where(F.length(F.trim("value")) > 0)
    return lines.select(*(F.get(f, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(x.split() for x in schema.split(", "))))


def read_m1(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _delimited(spark, path, M1_SCHEMA).where("score is not null")


def read_m4(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _delimited(spark, path, M4_SCHEMA).where("score is not null")


def read_m5(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _delimited(spark, path, M5_SCHEMA).withColumn("ticks", F.translate("ticks", "*", " "))


def read_rm4(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _delimited(spark, path, RM4_SCHEMA)


def read_regions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``chr start end`` files."""
    return _delimited(spark, path, "chr string, start long, end long")


def _attribute(name: str) -> Column:
    found = F.regexp_extract("attributes", rf'(?:^|;\s*){name}[ =]"?([^";]*)"?', 1)
    return F.when(found != "", found)


def read_gtf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Genes, transcripts and exons with the usual attributes; comments are left out."""
    lines = spark.read.text(_paths(spark, path)).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    f = F.split("value", "\t")
    rows = lines.select(*(f[i].try_cast(t).alias(n) for i, (n, t) in enumerate([("chr", "string"), ("source", "string"), ("type", "string"), ("start", "long"), ("end", "long"), ("score", "double"), ("strand", "string"), ("phase", "string")])), f[8].alias("attributes"))
    return rows.select("*", *(_attribute(a).alias(a) for a in ("gene_id", "transcript_id", "gene_type", "gene_name")), _attribute("level").try_cast("int").alias("level")).drop("attributes")


def read_repeatmasker(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of a ``.out`` file; numbers in parentheses count without them, header lines are left out."""
    schema = "sw_score int, pct_div double, pct_del double, pct_ins double, query string, start long, end long, left long, strand string, repeat string, class string, r_start int, r_end int, r_left int, id int"
    lines = spark.read.text(_paths(spark, path)).where(F.col("value").rlike(r"^\s*\d+\s"))
    f = F.split(F.trim("value"), r"\s+")
    return lines.select(*(F.get(f, F.lit(i)).alias(n) if t == "string" else F.regexp_replace(F.get(f, F.lit(i)), r"[()]", "").try_cast(t).alias(n) for i, (n, t) in enumerate(x.split() for x in schema.split(", "))))


def load_reads(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """``(name, seq)`` from FASTA, FASTQ, SAM or Parquet, by ``fmt`` or the ending of the path (a list file's first entry decides)."""
    end = (fmt or (_paths(spark, path)[0].rsplit(".", 1)[-1])).lower()
    if end in ("fa", "fasta", "fsta", "fna"):
        return read_fasta(spark, path).select("name", "seq")
    if end in ("fq", "fastq"):
        return read_fastq(spark, path).select("name", "seq")
    if end == "sam":
        return read_sam(spark, path).where("seq <> '*'").select(F.col("qname").alias("name"), "seq")
    if end == "parquet":
        return spark.read.parquet(*_paths(spark, path)).select("name", "seq")
    raise ValueError(f"unknown format {end!r}")


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    df.select(line).write.mode("overwrite").text(path)


def write_fasta(df: DataFrame, path: str, title: str, seq: str, width: int = 50) -> None:
    """Records with wrapped sequences; rows without a title or sequence are left out."""
    from helixframe.functions.seq import wrap

    write_lines(df.where(F.col(title).isNotNull() & F.col(seq).isNotNull()).select(F.concat(F.lit(">"), F.col(title), F.lit("\n"), wrap(seq, width)).alias("line")), path)


def write_fastq(df: DataFrame, path: str, title: str, seq: str, qual: str) -> None:
    """Four-line records; a null quality is written as 0."""
    q = F.array_join(F.transform(qual, lambda x: F.char(F.coalesce(x, F.lit(0)) + 33)), "")
    write_lines(df.where(F.col(title).isNotNull() & F.col(seq).isNotNull()).select(F.concat_ws("\n", F.concat(F.lit("@"), title), F.col(seq), F.lit("+"), F.coalesce(q, F.lit(""))).alias("line")), path)
