"""CIGAR strings and SAM flags as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the SAM flag.
FLAGS = {
    "paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32,
    "first": 64, "last": 128, "secondary": 256, "qc_fail": 512, "duplicate": 1024,
}


def has_flag(flag: Column | str, name: str) -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(F.lit(FLAGS[name])) != 0


def operations(cigar: Column | str) -> Column:
    """Array of (len, op); empty for ``*``, empty or null strings."""
    c = F.coalesce(F.col(cigar) if isinstance(cigar, str) else cigar, F.lit("*"))
    found = F.regexp_extract_all(c, F.lit(r"(\d+[MIDNSHPX=])"), 1)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def span(ops: Column, letters: str) -> Column:
    """Total length of the operations among ``letters``."""
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*letters)), F.lit(0), lambda a, o: a + o["len"])


def query_span(ops: Column) -> Column:
    return span(ops, "MX=I")


def ref_span(ops: Column) -> Column:
    return span(ops, "MX=DN")


def blocks(ops: Column) -> Column:
    """Gapless blocks (q_pos, t_pos, length), from the first aligned letter; successive M, X and = are one block."""
    block = "array<struct<q_pos:int,t_pos:int,length:int>>"
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("t"), F.lit(False).alias("open"), F.array().cast(block).alias("b"))

    def step(a: Column, o: Column) -> Column:
        aligned, n = o["op"].isin("M", "X", "="), o["len"]
        n_blocks = F.size(a["b"])
        last = F.element_at(a["b"], -1)
        grown = F.concat(
            F.slice(a["b"], 1, F.greatest(n_blocks - 1, F.lit(0))),
            F.array(F.struct(last["q_pos"].alias("q_pos"), last["t_pos"].alias("t_pos"), (last["length"] + n).alias("length"))),
        )
        fresh = F.concat(a["b"], F.array(F.struct(a["q"].alias("q_pos"), a["t"].alias("t_pos"), n.alias("length"))))
        return F.struct(
            F.when(aligned | (o["op"] == "I"), a["q"] + n).otherwise(a["q"]).alias("q"),
            F.when(aligned | o["op"].isin("D", "N"), a["t"] + n).otherwise(a["t"]).alias("t"),
            aligned.alias("open"),
            F.when(aligned & a["open"] & (n_blocks > 0), grown).when(aligned, fresh).otherwise(a["b"]).cast(block).alias("b"),
        )

    return F.aggregate(ops, start, step)["b"]


def from_blocks(blocks_col: Column) -> Column:
    """CIGAR of blocks: M for the blocks, I and D for what lies between on query and target."""
    n = F.size(blocks_col)

    def piece(b: Column, i: Column) -> Column:
        before = F.element_at(blocks_col, F.greatest(i, F.lit(1)))
        dq = F.when(i > 0, b["q_pos"] - before["q_pos"] - before["length"]).otherwise(0)
        dt = F.when(i > 0, b["t_pos"] - before["t_pos"] - before["length"]).otherwise(0)
        return F.concat(F.when(dq > 0, F.concat(dq.cast("string"), F.lit("I"))).otherwise(""), F.when(dt > 0, F.concat(dt.cast("string"), F.lit("D"))).otherwise(""), b["length"].cast("string"), F.lit("M"))

    return F.when(n > 0, F.array_join(F.transform(blocks_col, piece), "")).otherwise("*")


def clip(cigar: Column, left: Column, right: Column, how: str = "soft", flip: Column | None = None) -> Column:
    """Clipping added to a CIGAR: ``none``, ``soft`` or ``hard``; the ends swap where ``flip`` holds."""
    if how == "none":
        return cigar
    op = {"soft": "S", "hard": "H"}[how]
    a, b = (left, right) if flip is None else (F.when(flip, right).otherwise(left), F.when(flip, left).otherwise(right))
    part = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    return F.concat(part(a), cigar, part(b))
