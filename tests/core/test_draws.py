from hashlib import md5

from statuta.operators.draws import draws


def brute(ids, n, seed):
    order = sorted(ids, key=lambda i: (md5(f"{i}|{seed}".encode()).hexdigest(), i))
    found = {}
    for k in range(n):
        i = order[int(md5(f"draw|{k}|{seed}".encode()).hexdigest()[:15], 16) % len(order)]
        found[i] = found.get(i, 0) + 1
    return found


def counts(df):
    return {r.id: r.times for r in df.collect()}


def test_draws_equal_brute_force_whatever_the_partitions(spark):
    rows = spark.range(300).selectExpr("id", "id AS at", "id AS bucket", "'x' AS times", "id AS `a.b`")
    want = brute(range(300), 5000, 3)
    for parts, size in ((1, 1000), (7, 40), (3, 1)):
        made = draws(rows.repartition(parts), ["id"], 5000, 3, size)
        assert made.columns == ["id", "at", "bucket", "a.b", "times"]
        assert counts(made) == want
    assert counts(draws(rows, ["id"], 5000, 4)) != want


def test_counts_pass_a_chi_square_test(spark):
    found = counts(draws(spark.range(200), ["id"], 20_000, 11))
    assert sum(found.values()) == 20_000
    # 199 degrees of freedom: 99.9 % of such sums are below 267.5
    assert sum((found.get(i, 0) - 100) ** 2 / 100 for i in range(200)) < 267.5


def test_nothing_to_draw(spark):
    assert draws(spark.range(0), ["id"], 10).count() == 0
    assert draws(spark.range(10), ["id"], 0).count() == 0
    one = spark.createDataFrame([(None,)], "id long")
    assert counts(draws(one, ["id"], 10)) == {None: 10}
