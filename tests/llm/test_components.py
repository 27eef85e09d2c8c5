import random

from quillspark.llm.components import components


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 300), (400, 401), (401, 400), (400, 401)]
    edges += [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    touched = {n for a, b in edges if a != b for n in (a, b)}
    got = sorted(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == sorted((n, find(n)) for n in touched)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sets_that_no_pair_needs_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    from quillspark.llm.ngram_join import NgramJoin

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c d e f g h i j k l m n o p q r s t"), F.col("id").cast("string")).alias("text"))
    join = NgramJoin(docs.limit(1))
    sets = docs.select(F.col("doc_id").alias("f"), F.split("text", " ").alias("sh"))
    seen, pairs = {}, spark.createDataFrame([(1, 2), (1, 3), (7, 9)], "a long, b long")
    from quillspark.llm import ngram_join

    real = ngram_join.scratch.stage
    try:
        ngram_join.scratch.stage = lambda df, label: seen.setdefault(label, df) is None or real(df, label)
        found = join.verified(pairs, sets)
    finally:
        ngram_join.scratch.stage = real
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 3), (7, 9)]
    assert "bit_or" in seen["links"]._jdf.queryExecution().analyzed().toString()  # the map of the wanted sets
