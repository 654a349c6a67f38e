import random

import pytest

from factloom.operators import resolve


@pytest.mark.parametrize("most", [resolve.AUTOMATON, 20])
def test_mentions_equal_brute_force(spark, most):
    r = random.Random(3)
    parts = ["al", "be", "Cy", "dora", "Echo", "fo", "ü", "x9"]
    names = ["Al Be", "al", "Bo-Li", "dor", "Cy of Echo", "***", "ü", "zz top", "Echo"] + [" ".join(r.sample(parts, 2)) for _ in range(8)]
    texts = [(i, r.choice(["", "(", "pre"]) + r.choice([" ", "", "-"]).join(r.choice(parts) for _ in range(r.randint(1, 7)))) for i in range(60)]
    texts += [(100, "the bo-li one"), (101, "Xal bey"), (102, "rated ***!"), (103, None), (104, ""), (105, "nothing"), (None, "ZZ Top")]
    want = []
    for i, t in texts:
        fits = [n for n in names if t and (n.lower() in t.lower() or any(len(w) >= 4 and w in t.lower() for w in n.lower().split(" ")))]
        if fits:
            want.append((i, min(fits, key=lambda n: (-len(n), n))))
    t = spark.createDataFrame(texts, "text_id long, text string")
    got = [tuple(x) for x in resolve.mentions(t, spark.createDataFrame([(n,) for n in [*names, None, ""]], "name string"), most=most).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {(100, "Bo-Li"), (101, "Al Be"), (102, "***"), (None, "zz top")} <= set(got)


def test_mentions_of_nothing(spark):
    t = spark.createDataFrame([(1, "x")], "text_id long, text string")
    assert resolve.mentions(t, spark.createDataFrame([(None,), ("",)], "name string")).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("partitions", [1, 6])
def test_ranked_names_equal_brute_force(spark, partitions):
    r = random.Random(6)
    names = ["".join(r.choice("abäXy ") for _ in range(r.randrange(1, 9))).strip() or "a" for _ in range(60)] + ["abab", "ab", "Z\U0001f642z"]
    owners = [(n, [r.choice(["Q" + n[:2], "yy"])] if r.random() < 0.4 else None) for n in sorted(set(names))]
    inputs = ["".join(r.choice("abäxy") for _ in range(r.randrange(1, 4))) for _ in range(50)] + ["", " ", "\U0001f642", "none such", "AB ", "y", "qa"]
    fold = lambda t: t.strip().lower()
    want = []
    for i in sorted(set(inputs)):
        k, fits = fold(i), []
        for n, a in owners:
            how = 0 if fold(n) == k else 1 if any(fold(x) == k for x in a or ()) else 2 if k and any(k in fold(x) for x in [n, *(a or ())]) else None
            if how is not None:
                fits.append((how, len(n), n))
        want.append((i, min(fits)[2] if fits else None))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = resolve.resolve_ranked(spark.createDataFrame([(i,) for i in inputs], "input string"), spark.createDataFrame(owners, "name string, aliases array<string>"))
        got = sorted(map(tuple, df.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    assert "Cartesian" not in plan_of(df) and "NestedLoop" not in plan_of(df)
