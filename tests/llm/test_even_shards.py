from threadmill.llm import shards


def test_shards_are_evened_without_a_join_on_shards(spark, monkeypatch):
    """Each round looks up a point's shard in a short map; what is moved evens the shards out."""
    keys, kind = [], type(spark.range(1))
    real = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: keys.append(on) or real(self, other, on, how))
    rows = [(k, 10, 0, 10, 0) for k in range(40)] + [(100 + k, 10, 0, 10, 1) for k in range(20)]
    got = shards._evened(spark.createDataFrame(rows, "th long, size long, slice int, bytes long, shard int"), 2)
    assert {r.shard: r.w for r in got.groupBy("shard").agg({"bytes": "sum"}).withColumnRenamed("sum(bytes)", "w").collect()} == {0: 300, 1: 300}
    assert keys and "shard" not in keys


def test_rounds_join_no_points(spark, monkeypatch):
    """Many rounds over a few large points and many small ones: points are joined once, however many rounds there are, and
    as many bytes lie in each shard as by trying every point in every round."""
    sizes = [(k, 50 + 37 * (k % 11), k % 3 if k < 90 else 0) for k in range(120)]
    rows = [(k, w, 0, w, s) for k, w, s in sizes]
    load, at = {s: sum(w for _, w, x in sizes if x == s) for s in range(4)}, {k: s for k, _, s in sizes}
    weight, rounds = {k: w for k, w, _ in sizes}, 0
    allowed = shards.EVEN * sum(load.values()) / 4
    for _ in range(shards.MOST_ROUNDS):
        order = sorted(load, key=lambda k: (load[k], k))
        pairs = [(order[-1 - i], order[i], (load[order[-1 - i]] - load[order[i]]) / 2) for i in range(2)]
        if load[order[-1]] - load[order[0]] <= allowed or not (pairs := [p for p in pairs if p[2] > allowed / 4]):
            break
        best = [(b, min(((abs(weight[k] - h), k) for k in at if at[k] == a and weight[k] < 2 * h), default=None)) for a, b, h in pairs]
        if not any(x for _, x in best):
            break
        rounds += 1
        for b, x in best:
            if x:
                load[at[x[1]]] -= weight[x[1]]
                load[b] += weight[x[1]]
                at[x[1]] = b
    joins, kind = [], type(spark.range(1))
    real = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: joins.append(on) or real(self, other, on, how))
    got = shards._evened(spark.createDataFrame(rows, "th long, size long, slice int, bytes long, shard int"), 4).collect()
    assert rounds > 3 and len(joins) <= 1
    assert {r.th: r.shard for r in got} == at
