import random

import pytest

from millrace.operators import mix


def mixer_model(docs, weights, target):
    """The greedy rule, one document after the other."""
    queues = {d: list(v) for d, v in docs.items()}
    produced, out, dry, total = dict.fromkeys(weights, 0), [], [], 0
    live = set(weights)
    while live and total < target:
        d = min(live, key=lambda x: (produced[x] / weights[x], x))
        if not queues.get(d):
            live.remove(d)
            dry.append(d)
            continue
        pos, n = queues[d].pop(0)
        out.append((d, pos))
        produced[d] += n
        total += n
    return out, sorted(dry)


@pytest.mark.parametrize("seed", range(4))
def test_mixture_equals_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    docs = {d: [(i, rng.randint(1, 40)) for i in range(rng.choice([3, 40, 80]))] for d in weights}
    rows = [(d, p, n) for d, v in docs.items() for p, n in v] + [("other", 1, 5)]
    df = spark.createDataFrame(rows, "domain string, pos bigint, n_tokens bigint")
    for target in (1, 500, 10**9):
        want, dry = mixer_model(docs, weights, target)
        got = mix.mix_order(df, weights, target).orderBy("place").collect()
        assert [(r.domain, r.pos) for r in got] == want
        assert sorted(r.domain for r in mix.exhausted(df, weights, target).collect()) == dry


def test_shares_and_bad_weights(spark):
    df = spark.createDataFrame([("a", i, 10) for i in range(500)] + [("b", i, 30) for i in range(500)], "domain string, pos bigint, n_tokens bigint")
    stats = {r.domain: r for r in mix.mix_stats(mix.mix_order(df, {"a": 0.25, "b": 0.75}, 5000), {"a": 0.25, "b": 0.75}).collect()}
    assert abs(stats["a"].actual_share - 0.25) < 0.01
    none = mix.mix_stats(mix.mix_order(df.limit(0), {"a": 1.0}, 10), {"a": 1.0}).first()
    assert (none.tokens, none.documents, none.actual_share) == (0, 0, 0.0)
    for bad in ({}, {"a": 0.5}, {"a": 1.5, "b": -0.5}):
        with pytest.raises(ValueError):
            mix.mix_order(df, bad)


def test_unknown_domains_and_totals(spark):
    df = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "domain string, pos bigint, n_tokens bigint")
    assert mix.credited(df, {"a": 0.5, "b": 0.5}).count() == 2
    with pytest.raises(Exception, match="no weight for domain b"):
        mix.credited(df, {"a": 1.0}).collect()
    assert mix.check_totals(df, 30) == 30 and mix.check_totals(df.limit(0), 0) == 0
    with pytest.raises(ValueError):
        mix.check_totals(df, 31)
