import random

from conftest import rows_of

from helixframe.functions import seq
from helixframe.operators import index, relational


def texts(spark):
    rng = random.Random(9)
    rnd = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core = rnd(37)
    rows = [(1, rnd(80) + core + "G" + rnd(40)), (2, rnd(30) + core + "T"), (3, rnd(60)), (4, "NNN"), (5, ""), (6, None)]
    return rows, spark.createDataFrame(rows, "id long, seq string")


def test_longest_repeat(spark):
    rows, df = texts(spark)

    def repeats(k):
        seen = {}
        for _, t in rows:
            for p in range(len(t or "") - k + 1):
                w = t[p : p + k]
                if "N" not in w:
                    seen[w] = seen.get(w, 0) + 1
        return sum(n > 1 for n in seen.values())

    best = max(k for k in range(1, 60) if repeats(k))
    assert index.longest_repeat(df, "seq") == (best, repeats(best)) and best >= 37
    assert index.longest_repeat(df.where("id = 4"), "seq") == (0, 0)


def test_locate_and_prefixes(spark):
    rows, df = texts(spark)
    word = rows[0][1][10:16]
    p = spark.createDataFrame([(7, word), (8, "ACGTN-"), (9, None), (10, "AC")], "pid long, w string")
    expected = sorted((7, i, q) for i, t in rows if t for q in range(len(t) - 5) if t[q : q + 6] == word)
    assert rows_of(index.locate(p, "pid", "w", df, "id", "seq", 6)) == expected
    row = index.prefix_table(df, "id", "seq", 3).select(seq.decode_two_bit("kmer", 3).alias("w"), "n").collect()
    assert sum(r.n for r in row) == sum(max(0, len(t or "") - 2) for _, t in rows if t and "N" not in t)


def test_components(spark):
    _, df = texts(spark)
    assert rows_of(index.shared_word_components(df, "id", "seq", 30)) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)]


def test_titles(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "t string")
    assert rows_of(relational.title_table(df, "t")) == [("a", 0), ("b", 1)]
