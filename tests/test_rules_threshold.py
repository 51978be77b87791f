from kiln.operators.rules import frequent_itemsets


def test_both_paths_keep_itemsets_at_the_threshold(spark):
    for n in (8, 9):
        names = [f"c{i}" for i in range(n)]
        rows = [("yes" if i < 7 else f"n{i}", *(f"{c}{i}" for c in names[1:])) for i in range(100)]
        got = frequent_itemsets(spark.createDataFrame(rows, names), names, min_support=0.07).collect()
        assert [(r["support"], r["length"]) for r in got] == [(0.07, 1)], n
