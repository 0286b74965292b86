"""Alignment rows as lines of the text formats, and SAM headers. Inputs are rows of ``map_reads`` with names and, where needed, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import cigar as cg
from helixframe.functions.seq import read_group_id, reverse_complement

_s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")

M1_COLUMNS = "qname tname qstrand tstrand score pctsim tstart tend tlen qstart qend qlen ncells".split()
M4_COLUMNS = "qname tname score pctsim qstrand qstart qend qlen tstrand tstart tend tlen mapqv".split()


def _oriented() -> dict[str, Column]:
    """Coordinates with the read forward and the contig on the strand that aligns."""
    back = F.col("strand") == 1
    return {
        "qs": F.when(back, F.col("q_length") - F.col("q_end")).otherwise(F.col("q_start")),
        "qe": F.when(back, F.col("q_length") - F.col("q_start")).otherwise(F.col("q_end")),
        "ts": F.when(back, F.col("t_length") - F.col("t_end")).otherwise(F.col("t_start")),
        "te": F.when(back, F.col("t_length") - F.col("t_start")).otherwise(F.col("t_end")),
    }


def _identity() -> Column:
    return F.format_string("%.4f", F.col("pct_similarity"))


def m1(df: DataFrame, sep: str = " ") -> DataFrame:
    """``line``: summary format."""
    o = _oriented()
    return df.select(F.concat_ws(sep, "q_name", "t_name", F.lit("0"), _s("strand"), _s("score"), _identity(), _s(o["ts"]), _s(o["te"]), _s("t_length"), _s(o["qs"]), _s(o["qe"]), _s("q_length"), _s("weight")).alias("line"))


def m4(df: DataFrame, sep: str = " ") -> DataFrame:
    """``line``: interval format."""
    o = _oriented()
    return df.select(F.concat_ws(sep, "q_name", "t_name", _s("score"), _identity(), F.lit("0"), _s(o["qs"]), _s(o["qe"]), _s("q_length"), _s("strand"), _s(o["ts"]), _s(o["te"]), _s("t_length"), _s("map_qv")).alias("line"))


def m3_vulgar(df: DataFrame) -> DataFrame:
    """``line``: names, bounds, score, then triples of operation, query length, target length."""
    ops = cg.operations("cigar")
    part = F.transform(ops, lambda o: F.concat(F.when(o["op"].isin("=", "X"), "M").otherwise(o["op"]), F.lit(" "), F.when(o["op"] == "D", 0).otherwise(o["len"]).cast("string"), F.lit(" "), F.when(o["op"] == "I", 0).otherwise(o["len"]).cast("string")))
    return df.select(F.concat_ws(" ", F.lit("vulgar:"), "q_name", _s("q_start"), _s("q_end"), F.lit("+"), "t_name", _s("t_start"), _s("t_end"), F.when(F.col("strand") == 1, "-").otherwise("+"), _s("score"), F.array_join(part, " ")).alias("line"))


def m5(df: DataFrame) -> DataFrame:
    """``line``: statistics and the three gapped strings; needs q_string, ticks, t_string. A blank tick is written ``*``."""
    return df.select(
        F.concat_ws(
            " ", "q_name", _s("q_length"), _s("q_start"), _s("q_end"), F.lit("+"), "t_name", _s("t_length"), _s("t_start"), _s("t_end"), F.when(F.col("strand") == 1, "-").otherwise("+"),
            _s("score"), _s("n_match"), _s("n_mismatch"), _s("n_ins"), _s("n_del"), _s("map_qv"), "q_string", F.translate("ticks", " ", "*"), "t_string",
        ).alias("line")
    )


def m0_stick(df: DataFrame, width: int = 60) -> DataFrame:
    """``line``: header and the alignment in rows of ``width`` columns; needs the gapped strings."""
    n = F.length("q_string")
    rows = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(width)),
        lambda i: F.concat_ws("\n", *(F.substring(F.col(c), i + 1, F.lit(width)) for c in ("q_string", "ticks", "t_string"))),
    )
    head = F.concat_ws(" ", F.lit("Query:"), "q_name", F.lit("Target:"), "t_name", F.lit("score:"), _s("score"), F.lit("similarity:"), _identity())
    return df.select(F.concat(head, F.lit("\n"), F.array_join(rows, "\n\n")).alias("line"))


def m2_xml(df: DataFrame) -> DataFrame:
    """``line``: one element a hit; needs the gapped strings."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    attribute = lambda n, v: F.concat(F.lit(f' {n}="'), v, F.lit('"'))
    head = F.concat(
        F.lit("<hit"), attribute("name", esc("q_name")), attribute("target", esc("t_name")), attribute("start", _s("q_start")), attribute("end", _s("q_end")),
        attribute("targetStart", _s("t_start")), attribute("targetEnd", _s("t_end")), attribute("strand", F.when(F.col("strand") == 1, "-").otherwise("+")), attribute("score", _s("score")), F.lit(">"),
    )
    return df.select(F.concat(head, F.lit("<query>"), "q_string", F.lit("</query><target>"), "t_string", F.lit("</target></hit>")).alias("line"))


def quality_string(values: Column) -> Column:
    """Quality values as letters, code plus 33; a null or negative value counts as 0, one above 93 as 93."""
    return F.array_join(F.transform(values, lambda x: F.char(F.greatest(F.least(F.coalesce(x, F.lit(0)), F.lit(93)), F.lit(0)) + 33)), "")


def sam_body(df: DataFrame, clipping: str = "soft", qual: str | None = None, qv_tags: dict[str, str] | None = None, passed: list[str] | None = None) -> DataFrame:
    """``line``: aligned records. Needs ``seq`` (forward read). Clips none, soft, hard or subread.

    ``qual`` names an array column of quality values of the forward read, which becomes QUAL (``*`` without it, or where it isn't as long
    as the read); ``qv_tags`` maps two-letter tags to further such columns; both are turned and cut like the bases. ``passed``
    names columns with whole tags that are put at the end. ``subread``: the record's bases are the aligned ones, the CIGAR has
    no clips, and XS and XE are places in the whole read.
    """
    left, right = F.col("q_start"), F.col("q_length") - F.col("q_end")
    back, inside = F.col("strand") == 1, clipping != "soft"
    bases = F.when(back, reverse_complement("seq")).otherwise(F.upper("seq"))
    if inside:
        bases = F.substring(bases, F.col("q_start") + 1, F.col("q_end") - F.col("q_start"))

    def qualities(column: str) -> Column:
        known = F.size(column) == F.length("seq")
        turned = F.when(back, F.reverse(F.col(column))).otherwise(F.col(column))
        if inside:
            turned = F.slice(turned, F.col("q_start") + 1, F.col("q_end") - F.col("q_start"))
        return F.when(known, quality_string(turned))

    flag = F.when(back, cg.FLAGS["reverse"]).otherwise(0) + F.when(F.col("is_primary"), 0).otherwise(cg.FLAGS["secondary"])
    tags = [F.concat(F.lit("RG:Z:"), read_group_id(F.substring_index("q_name", "/", 1))), F.concat(F.lit("AS:i:"), _s("score")), F.concat(F.lit("XS:i:"), _s(F.col("q_start") + 1)), F.concat(F.lit("XE:i:"), _s(F.col("q_end") + 1)), F.concat(F.lit("XL:i:"), _s(F.col("q_end") - F.col("q_start"))), F.concat(F.lit("NM:i:"), _s(F.col("n_mismatch") + F.col("n_ins") + F.col("n_del"))), F.lit("XT:i:1")]
    tags += [F.concat(F.lit(f"{tag}:Z:"), qualities(c)) for tag, c in (qv_tags or {}).items()] + [F.col(c) for c in passed or []]
    quality = F.coalesce(qualities(qual), F.lit("*")) if qual else F.lit("*")
    clipped = cg.clip(F.col("cigar"), left, right, "none" if clipping == "subread" else clipping)
    return df.select(F.concat_ws("\t", "q_name", _s(flag), "t_name", _s(F.col("t_start") + 1), _s("map_qv"), clipped, F.lit("*"), F.lit("0"), _s(F.col("t_end") - F.col("t_start")), bases, quality, *tags).alias("line"))


def sam_unaligned(reads: DataFrame) -> DataFrame:
    """``line``: records of reads ``(q_name, seq)`` without a place."""
    return reads.select(F.concat_ws("\t", "q_name", F.lit(str(cg.FLAGS["unmapped"])), *(F.lit(x) for x in "*0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), F.upper("seq"), F.lit("*")).alias("line"))


def sam_header(contigs: DataFrame, movies: DataFrame | None = None, program: str = "helixframe") -> DataFrame:
    """``(line_no, line)``: @HD, one @SQ per contig ``(t_name, t_length[, md5])``, one @RG per movie ``(movie_name)``, @PG."""
    spark = contigs.sparkSession
    md5 = F.when(F.col("md5").isNotNull(), F.concat(F.lit("\tM5:"), "md5")).otherwise("") if "md5" in contigs.columns else F.lit("")
    lines = spark.range(1).select(F.lit(0).alias("line_no"), F.lit("@HD\tVN:1.5\tSO:unknown").alias("line"))
    lines = lines.unionByName(contigs.select(F.lit(1).alias("line_no"), F.concat(F.lit("@SQ\tSN:"), "t_name", F.lit("\tLN:"), _s("t_length"), md5).alias("line")))
    if movies is not None:
        lines = lines.unionByName(movies.where("movie_name is not null").select(F.lit(2).alias("line_no"), F.concat(F.lit("@RG\tID:"), read_group_id("movie_name"), F.lit("\tPU:"), "movie_name").alias("line")))
    return lines.unionByName(spark.range(1).select(F.lit(3).alias("line_no"), F.lit(f"@PG\tID:{program}\tPN:{program}").alias("line")))
