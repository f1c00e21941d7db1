import random

from marketloom.llm import mixing


def reshared(sizes, weights):
    """Shares by weight, capped at three sizes, the excess dealt again until none is above."""
    target, open_, rest = {}, dict(zip(sizes, weights)), float(sum(sizes.values()))
    while open_:
        total = sum(open_.values())
        over = [s for s, w in open_.items() if rest * w / total > 3 * sizes[s]]
        if not over:
            return target | {s: rest * w / total for s, w in open_.items()}
        for s in over:
            target[s] = 3.0 * sizes[s]
            del open_[s]
        rest -= sum(target[s] for s in over)
    return target


def test_targets_equal_repeated_resharing(spark):
    r = random.Random(2)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{i:02d}": r.choice([0, 1, 5, 50, 1000, 20_000]) for i in range(n)}
        weights = [mixing.WEIGHTS[i % 3] for i in range(n)]
        got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = reshared(sizes, weights)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)
