from tessera.operators.registry import IN, OUT, run


def test_baskets_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    baskets = spark.createDataFrame([(["a", "b", "a"],), (["a", "b"],), (["a"],), (["c"],)], "items array<string>").mapInArrow(counted, "items array<string>")
    sets = run("frequent-item-set", {IN: baskets}, attribute="items", min_support=0.5)[OUT]
    assert sorted((tuple(r["items"]), r.freq, r.support) for r in sets.collect()) == [(("a",), 3, 0.75), (("a", "b"), 2, 0.5), (("b",), 2, 0.5)]
    assert seen.value == 4
