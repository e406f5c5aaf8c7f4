import random

from runweave.operators import graphs


def test_closure_from_every_job_of_an_estate(spark):
    rnd = random.Random(3)
    edges = sorted({(a, b) for a in range(60) for b in rnd.sample(range(60), 2) if rnd.random() < 0.6} | {(100, 101), (101, 100), (102, 102)})
    reached, new = set(), {b for a, b in edges if a != b}
    while new:
        reached |= new
        new = {b for a, b in edges if a in new and a != b} - reached
    df = spark.createDataFrame(edges, "job long, dep long")
    got = [r["job"] for r in graphs.closure(df.select("job").distinct(), df).collect()]
    assert len(got) == len(set(got)) and set(got) == reached
