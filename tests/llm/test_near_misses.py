"""Dense groups for near-dedup: many near misses, a model with noisy copies, and the exact setting."""

import random

import pytest

from riverlog.llm import neardup

from .test_linking import plain_components


def components_of(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in neardup.near_components(docs, neardup.NearSettings(words=2, **settings)).collect()}


def noisy(rng, base, share, fresh):
    return [next(fresh) if rng.random() < share else w for w in base]


def fresh_words():
    n = 0
    while True:
        n += 1
        yield f"new{n}"


def test_near_misses_are_not_linked_and_give_no_rows(spark):
    rng, fresh, base = random.Random(3), fresh_words(), [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(noisy(rng, base, 0.12, fresh))) for i in range(2000)]
    rows += [(2000, rows[7][1] + " tail"), (2001, "head " + rows[1999][1])]
    got = components_of(spark, rows)
    assert got[2000] == 7 and got[2001] == 1999
    assert all(got[i] == i for i in range(2000))


@pytest.mark.parametrize("loss", [1e-6, 0.0])
def test_noisy_copies_around_a_model(spark, loss):
    rng, fresh, base = random.Random(4), fresh_words(), [f"w{i}" for i in range(100)]
    words = [f"v{i}" for i in range(40)]  # noise that copies share by chance
    rows = [(0, " ".join(base))]
    for i in range(1, 250):
        share = rng.choice([0.02, 0.05, 0.08, 0.12])
        rows.append((i, " ".join(noisy(rng, base, share, iter(lambda: rng.choice(words), None) if i % 2 else fresh))))
    want, _ = plain_components(rows, 2)
    assert components_of(spark, rows, loss=loss) == want
    assert 1 < len(set(want.values())) < 250
