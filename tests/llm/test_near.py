from conftest import rows_of

from helixframe.llm import leakage


def near_by_hand(docs, items, terms, within):
    count = {}
    for _, t in docs:
        for w in leakage.words(t):
            count[w] = count.get(w, 0) + 1
    out = []
    for i, t in items:
        rarest = sorted({w for w in leakage.words(t) if w in count}, key=lambda w: (count[w], w))[:terms]
        for d, text in docs:
            ws = leakage.words(text)
            if len(rarest) == terms and any(w == rarest[0] and all(r in ws[max(0, k - within + 1) : k + within] for r in rarest) for k, w in enumerate(ws)):
                out.append((d, i))
    return sorted(out)


def test_near_does_not_depend_on_segments(spark):
    docs = [(1, "a rare b other c zebra"), (2, "rare rare rare zebra x y"), (3, "other a b c"), (4, "zebra " * 5), (5, "other b " + "x " * 40 + "zebra rare")]
    items = [(7, "rare other b unseen"), (8, "zebra rare y"), (9, "unseen nowhere"), (10, "other rare zebra")]
    e = spark.createDataFrame(items, "item_id long, item_text string")
    expected = near_by_hand(docs, items, 2, 20)
    assert (1, 7) in expected and (2, 8) in expected
    for parts in (1, 5):
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts, "doc_id")
        for size in (1, 8_000_000):
            saved, leakage.SEGMENT_CHARS = leakage.SEGMENT_CHARS, size
            try:
                index = leakage.build_index(d, "doc_id", "text")
                assert rows_of(leakage.proximity_search(index, e, "item_id", "item_text", terms=2, within=20)) == expected
            finally:
                leakage.SEGMENT_CHARS = saved
