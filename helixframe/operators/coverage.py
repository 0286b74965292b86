"""Coverage, support, consensus, gaps and variants along references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.relational import with_bins


def binned_coverage(df: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """``(key, bin, bases, mean_coverage)``: aligned bases per bin of ``width``; bins without any are absent."""
    rows = with_bins(df.select(key, F.col(start).alias("_s"), F.col(end).alias("_e")), "_s", "_e", width)
    inside = F.least(F.col("_e"), (F.col("_bin") + 1) * width) - F.greatest(F.col("_s"), F.col("_bin") * width)
    return rows.groupBy(key, F.col("_bin").alias("bin")).agg(F.sum(inside).alias("bases"), F.round(F.sum(inside) / width, 6).alias("mean_coverage"))


def coverage_steps(df: DataFrame, key: str, start: str, end: str, width: int = 1 << 20) -> DataFrame:
    """``(key, from_pos, to_pos, depth)``: stretches of equal depth above 0, by a sweep over opening and closing ends.

    The sweep runs within blocks of ``width`` positions, so a hot key is many tasks: each interval opens anew in every
    block it reaches, and the block's border ends what is still open. Equal depths that meet at a border are not joined.
    """
    rows = with_bins(df.select(key, F.col(start).alias("_s"), F.col(end).alias("_e")), "_s", "_e", width)
    ends = F.explode(F.array(F.struct(F.greatest(F.col("_s"), F.col("_bin") * width).alias("p"), F.lit(1).alias("d")), F.struct(F.least(F.col("_e"), (F.col("_bin") + 1) * width).alias("p"), F.lit(-1).alias("d"))))
    steps = rows.select(key, "_bin", ends.alias("x")).groupBy(key, "_bin", "x.p").agg(F.sum("x.d").alias("d")).where("d <> 0")
    w = Window.partitionBy(key, "_bin").orderBy("p")
    sweep = steps.select(key, F.col("p").alias("from_pos"), F.lead("p").over(w).alias("to_pos"), F.sum("d").over(w).alias("depth"))
    return sweep.where("depth > 0 and to_pos is not null")


def end_support(df: DataFrame, key: str, start: str, end: str, width: int, least_length: int) -> DataFrame:
    """``(key, bin, support, n)``: per bin the largest distance of its middle to the nearer end of an alignment over it, and their number."""
    rows = with_bins(df.where(F.col(end) - F.col(start) >= least_length).select(key, F.col(start).alias("_s"), F.col(end).alias("_e")), "_s", "_e", width)
    middle = F.col("_bin") * width + width // 2
    rows = rows.withColumn("_d", F.least(middle - F.col("_s"), F.col("_e") - middle)).where("_d >= 0")
    return rows.groupBy(key, F.col("_bin").alias("bin")).agg(F.max("_d").alias("support"), F.count("*").alias("n"))


def operations_on_reference(df: DataFrame, ops: str, start: str) -> DataFrame:
    """One row per CIGAR operation: ``op, len, t_from`` with its place on the reference (all other columns kept).

    One pass over the operations carries the place along.
    """
    none = F.expr("cast(array() as array<struct<op:string,len:bigint,moved:bigint>>)")

    def step(done, o):
        at, n = done["at"], o["len"].cast("long")
        placed = F.struct(o["op"].alias("op"), n.alias("len"), at.alias("moved"))
        return F.struct((at + F.when(o["op"].isin("M", "=", "X", "D", "N"), n).otherwise(F.lit(0).cast("long"))).alias("at"), F.concat(done["placed"], F.array(placed)).alias("placed"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("placed"))
    rows = df.select("*", F.posexplode(F.aggregate(F.col(ops), begin, step, lambda done: done["placed"])).alias("op_no", "_o"))
    kept = [c for c in df.columns if c != ops]
    return rows.select(*kept, "op_no", F.col("_o.op").alias("op"), F.col("_o.len").cast("int").alias("len"), (F.col(start) + F.col("_o.moved")).alias("t_from"))


def consensus_counts(placed: DataFrame, key: str, width: int) -> DataFrame:
    """``(key, bin, m, d, i)`` from placed operations: matched and deleted bases by position, inserted bases where they stand."""
    rows = placed.where(F.col("op").isin("M", "=", "X", "D", "I") & (F.col("len") > 0)).select(key, "op", F.col("len").cast("long").alias("len"), "t_from")
    last = F.when(F.col("op") == "I", F.col("t_from")).otherwise(F.col("t_from") + F.col("len") - 1)
    flat = rows.withColumn("_bin", F.explode(F.sequence(F.expr(f"t_from div {width}"), F.floor(last / width))))
    inside = F.least(F.col("t_from") + F.col("len"), (F.col("_bin") + 1) * width) - F.greatest(F.col("t_from"), F.col("_bin") * width)
    of = lambda when, n: F.sum(F.when(when, n).otherwise(F.lit(0).cast("long")))
    return flat.groupBy(key, F.col("_bin").alias("bin")).agg(of(F.col("op").isin("M", "=", "X"), inside).alias("m"), of(F.col("op") == "D", inside).alias("d"), of(F.col("op") == "I", F.col("len")).alias("i"))


def merged_gaps(placed: DataFrame, row_id: str, merge_within: int, least: int) -> DataFrame:
    """Long indels ``(row_id, op, t_from, len, n_parts)``: gaps of one kind closer than ``merge_within`` on the reference are one."""
    gaps = placed.where(F.col("op").isin("I", "D"))
    w = Window.partitionBy(row_id, "op").orderBy("t_from", "op_no")
    end = F.col("t_from") + F.when(F.col("op") == "D", F.col("len")).otherwise(0)
    gaps = gaps.withColumn("_new", F.when(F.col("t_from") - F.lag(end).over(w) < merge_within, 0).otherwise(1)).withColumn("_part", F.sum("_new").over(w))
    rows = gaps.groupBy(row_id, "op", "_part").agg(F.min("t_from").alias("t_from"), F.sum("len").cast("int").alias("len"), F.count("*").alias("n_parts"))
    return rows.where(F.col("len") >= least).drop("_part")


def gappy_bins(counts: DataFrame, threshold: float) -> DataFrame:
    """Bins whose share of inserted or deleted bases is above the threshold, with both shares."""
    total = F.col("m") + F.col("d")
    rows = counts.where(total > 0).select("*", F.round(F.col("i") / total, 6).alias("ins_ratio"), F.round(F.col("d") / total, 6).alias("del_ratio"))
    return rows.where((F.col("ins_ratio") > threshold) | (F.col("del_ratio") > threshold))


def column_profile(columns: DataFrame, keys: list[str], base: str) -> DataFrame:
    """``(keys, coverage, consensus, support)``: the most frequent base of each column, of equals the first in A, C, G, T, - order."""
    counts = columns.groupBy(*keys, base).agg(F.count("*").alias("_n"))
    order = F.instr(F.lit("ACGT-"), F.col(base))
    return counts.groupBy(*keys).agg(F.sum("_n").alias("coverage"), F.max_by(base, F.struct("_n", -order)).alias("consensus"), F.max("_n").alias("support"))


def call_variants(profile: DataFrame, key: str, pos: str, reference: str, before: int = 5, after: int = 4) -> DataFrame:
    """``(key, pos, kind, ref, alt, support, mean_coverage)``: columns whose consensus isn't the reference (``-`` is a deletion).

    mean_coverage is that of the columns from ``before`` before to ``after`` after, to judge the support by.
    """
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(-before, after)
    rows = profile.withColumn("mean_coverage", F.round(F.avg("coverage").over(w), 6)).where(F.col("consensus") != F.col(reference))
    return rows.select(key, pos, F.when(F.col("consensus") == "-", "deletion").otherwise("snv").alias("kind"), F.col(reference).alias("ref"), F.col("consensus").alias("alt"), "support", "mean_coverage")


def insertion_calls(placed: DataFrame, spans: DataFrame, key: str, row_id: str, start: str, end: str, least: int, share: float, width: int = 1024) -> DataFrame:
    """Places where reads insert bases: ``(key, t_from, length, n_ins, coverage)``.

    ``n_ins`` alignments insert before ``t_from``, most often ``length`` letters (of equals the shorter); ``coverage`` is the number of
    ``spans`` (key, row_id, start, end) over the place, their ends not counted. Called are places with ``least`` or more insertions
    and at least ``share`` of the coverage. Insertions are counted before they meet the spans.
    """
    lengths = placed.where((F.col("op") == "I") & (F.col("len") > 0)).groupBy(key, "t_from", "len").agg(F.count("*").alias("_n"))
    sites = lengths.groupBy(key, "t_from").agg(F.sum("_n").alias("n_ins"), F.max_by("len", F.struct("_n", -F.col("len"))).alias("length")).where(F.col("n_ins") >= least)
    sites = sites.withColumn("_bin", F.expr(f"t_from div {width}"))
    over = with_bins(spans.select(key, row_id, F.col(start).alias("_s"), F.col(end).alias("_e")), "_s", "_e", width)
    met = sites.join(over, [key, "_bin"]).where((F.col("_s") < F.col("t_from")) & (F.col("t_from") < F.col("_e")))
    found = met.groupBy(key, "t_from", "length", "n_ins").agg(F.count("*").alias("coverage"))
    return found.where(F.col("n_ins") >= share * F.col("coverage"))


def msa_columns(columns: DataFrame, keys: list[str], pos: str, row: str, base: str, block: int = 1000) -> DataFrame:
    """Columns of a multiple alignment as text: ``(keys, pos, block, bases, depth)``, a letter for each row in the rows' order.

    Rows are taken ``block`` at a time by their whole-number id, so a deep column is several rows of the result.
    """
    at = columns.withColumn("block", F.expr(f"`{row}` div {block}"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(base).alias("b"))))
    return at.groupBy(*keys, pos, "block").agg(F.array_join(F.transform(rows, lambda x: x["b"]), "").alias("bases"), F.count("*").alias("depth"))
