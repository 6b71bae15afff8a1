"""Conversation repair, importance resampling and language-model scores against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverlog.llm import conversations, language, queries, resampling
from tests.compare import assert_same

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_importance_resampling"])
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert assert_same(queries.queries()[name](spark, sf_dir), sf_dir, queries.oracle_sql()[name])


def faults(rows):
    """(role, text, fault) of sorted rows."""
    seen, out = set(), []
    for role, text in rows:
        said = text.rstrip(" \t\n\x0b\f\r")
        out.append((role, text, "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def cheapest(rows):
    """The cheapest audit by trying all edits: states are the emitted initials; more than two insertions at one place never pay."""
    reached = {"": (0, "")}  # initials so far, and the best (cost, audit) for them
    ok = re.compile(r"s?(ua)*u?")

    def inserted(reached):
        out = dict(reached)
        for _ in range(2):
            for initials, (cost, audit) in list(out.items()):
                for c in "ua":
                    if ok.fullmatch(initials + c):
                        out[initials + c] = min(out.get(initials + c, (math.inf, "")), (cost + 5, audit + "I"))
        return out

    for role, _, fault in rows:
        new = {}
        for initials, (cost, audit) in inserted(reached).items():
            ways = [(initials, cost + 2, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                ways += [(initials + role[:1], cost + extra, "K")] if role[:1] else []
                ways += [(initials + c, cost + extra + 1, "R") for c in "ua"]
            for to, price, letter in ways:
                if ok.fullmatch(to):
                    new[to] = min(new.get(to, (math.inf, "")), (price, audit + letter))
        reached = new
    return min(v for k, v in inserted(reached).items() if re.fullmatch("(s?(ua)+)?", k))


def applied(rows, audit):
    left, out = list(rows), []
    for c in audit:
        role, text = ("", "") if c == "I" else left.pop(0)[:2]
        if c != "D":
            system = bool(out) and out[0][0].startswith("s")
            out.append((role if c == "K" else "ua"[(len(out) - system) % 2], text))
    return [({"u": "user", "a": "assistant"}.get(role, role), text) for role, text in out]


def random_turns(rng, n):
    roles, texts = ["system", "user", "assistant", "tool", "user", "assistant"], ["Yes.", "No!", "cut", " \n", "", "What?", "So. \t", "More", None]
    return [(c, None if rng.random() < 0.1 else rng.randint(0, 6), rng.choice([*roles, None]), rng.choice(texts)) for c in range(n) for _ in range(rng.randint(1, 7))]


@pytest.mark.parametrize("block", [2, 512])
def test_repair_is_the_cheapest_of_all(spark, block):
    rows = random_turns(random.Random(block), 150)
    found = conversations.repaired(spark.createDataFrame(rows, TURNS).withColumn("cost", F.lit("x")), block).collect()
    assert len(found) == 150
    for r in found:
        mine = sorted(((t is not None, t or 0), role or " ", " " if text is None else text) for c, t, role, text in rows if c == r["conv_id"])
        marked, turns = faults([x[1:] for x in mine]), [x[0][1] for x in mine if x[0][0]]
        assert (r["cost"], r["audit"]) == cheapest(marked)
        assert [tuple(t) for t in r["turns"]] == applied(marked, r["audit"])
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    found = {}
    for r in conversations.damaged(spark.createDataFrame(rows, TURNS)).collect():
        found.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["dropped"]))
    for c, t, role, text in rows:
        fate, role, text = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20, role or " ", text or " "
        want = {0: [(role, text, True)], 1: [(role, "", False)], 2: [(role, re.sub("[.!?]", "", text), False)], 3: [(role, text, False)] * 2, 4: [("user", text, False)]}
        assert found[c, t] == want.get(fate, [(role, text, False)])


def test_conversations_without_turns_and_long_ones(spark):
    none = conversations.repaired(conversations.damaged(spark.createDataFrame([], TURNS)))
    assert none.count() == 0
    dropped = spark.createDataFrame([(1, 1, "user", "x")], TURNS).withColumn("dropped", F.lit(True))
    assert [tuple(r) for r in conversations.repaired(dropped).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", [])]
    long = spark.range(20_000).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('Turn ', id, '.') AS text")
    (r,) = conversations.repaired(long).collect()
    assert (r["cost"], r["audit"], r["gaps"], len(r["turns"])) == (0, "K" * 20_000, 0, 20_000)
    empty = hashlib.sha256(b"").hexdigest()
    assert empty == spark.createDataFrame([("",)], "t string").select(F.sha2("t", 256)).first()[0]


def plain_features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_by_plain_python(spark, odd, documents, sf_dir, n):
    s = resampling.ResamplingSettings(n=n, min_words=5, percent=30, buckets=500)
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = odd.drop("rank").withColumn("score", F.lit("other")).withColumn("weight", F.lit(1))
    found = resampling.ranked(docs, target, settings=s).collect()
    buckets = lambda texts: Counter(zlib.crc32(f.encode()) % s.buckets for t in texts for f in plain_features(t, n)[1])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    raw, goal = buckets(t for _, t in rows), buckets(r["text"] for r in target.collect())
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (raw.total() + s.buckets) / ((raw[b] + 1) * (goal.total() + s.buckets)))) for b in raw}
    want = []
    for i, text in rows:
        words, features = plain_features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % s.buckets] for f in features)
        want.append((i, words, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((w for w in want if w[1] >= s.min_words), key=lambda w: (-w[4], w[0] is None, w[0] or 0, w[2]))
    drawn = len(order) * s.percent // 100
    assert drawn
    ranks = [(*w, k + 1 if k < drawn else None) for k, w in enumerate(order)] + [(*w, None) for w in want if w[1] < s.min_words]
    assert Counter(map(tuple, found)) == Counter(ranks)
    drawn_ids = {w[0] for w in ranks if w[5]}
    assert {r["doc_id"] for r in resampling.resample(docs, target, settings=s).collect()} == drawn_ids


def test_resampling_without_rows(spark, no_documents, odd):
    target = odd.select("text")
    assert resampling.ranked(no_documents, target).count() == 0
    assert resampling.ranked(odd, no_documents).filter("rank is not null").count() == 0  # 5 documents of 20 words, a tenth of which is none


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


@pytest.fixture(scope="module")
def small_model(spark, documents):
    docs = spark.createDataFrame([d[:2] for d in documents], "doc_id long, text string")
    settings = language.LanguageSettings(vocabulary=300, common=200)
    return docs, language.fit(docs.filter(~language.is_held_out(F.col("doc_id"))), settings=settings)


def test_counts_and_base_scores(spark, small_model, documents, odd, odd_documents):
    docs, model = small_model
    train = Counter(w for i, t, _ in documents if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens_of(t))
    assert (model.arrays.tokens, model.arrays.distinct) == (train.total(), len(train))
    for frame, rows in ((docs, documents), (odd.withColumn("score", F.lit("x")), odd_documents)):
        found = Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in language.scored(frame, model).collect())
        base = lambda ws: sum(math.log10((train[w] + 1) / (train.total() + len(train) + 1)) for w in ws)
        assert found == Counter((i, len(ws), sum(w in train for w in ws), round(base(ws), 6)) for i, t, _ in rows for ws in [tokens_of(t)])


def test_scores_are_sums_of_the_models_probabilities(small_model, documents):
    docs, model = small_model
    a = model.arrays
    code = {int(h): k for k, h in enumerate(a.hashes)}
    hash_of = lambda w: language.xxhash.xxh3_64_intdigest(w.encode()) >> 1
    seated = {r["key"]: r["value"] for r in model.pairs.collect()} | dict(zip(a.pairs.tolist(), a.seated.tolist(), strict=True))
    counts = {-1 - r["key"]: r["value"] for r in model.rare.collect()}
    assert 200 < len(a.pairs) + model.pairs.count() and len(a.pairs) <= 200 and len(a.hashes) <= 300 and counts
    found = {r["doc_id"]: r["score"] for r in language.scored(docs, model).collect()}
    for i, text, _ in documents:
        before, total = a.rare + 1, 0.0
        for w in tokens_of(text):
            k = code.get(hash_of(w), a.rare)
            p = seated.get(before << 32 | k, 0.0) / (a.strength + a.totals[before]) + np.mean([g[before] * r[k] for g, r in zip(a.mass, a.parent, strict=True)])
            total += math.log10(p) + (math.log10((counts.get(hash_of(w), 0) + 1) / a.rare_size) if k == a.rare else 0)
            before = k
        assert found[i] == pytest.approx(total, abs=1e-6)


def test_probabilities_sum_to_one(small_model):
    a, model = small_model[1].arrays, small_model[1]
    assert a.parent.sum(1) == pytest.approx([1, 1])
    seated = {r["key"]: r["value"] for r in model.pairs.collect()} | dict(zip(a.pairs.tolist(), a.seated.tolist(), strict=True))
    sums = np.zeros(a.rare + 2)
    for key, value in seated.items():
        sums[key >> 32] += value
    assert sums / (a.strength + a.totals) + a.mass.mean(0) == pytest.approx(np.ones(a.rare + 2))
    assert sum(v + 1 for v in (r["value"] for r in model.rare.collect())) + 1 == a.rare_size


@pytest.fixture(scope="module")
def own_model(spark, documents):
    docs = spark.createDataFrame([d[:2] for d in documents], "doc_id long, text string")
    return docs, language.fit(docs.filter(~language.is_held_out(F.col("doc_id"))), settings=language.LanguageSettings(vocabulary=300, common=200, own_rare=True))


def test_rare_words_are_contexts_and_dishes_of_their_own(own_model, documents):
    """No word shares a context with others: scores by plain Python from the seating, and all that follows a context sums to one."""
    docs, model = own_model
    a, own = model.arrays, {}
    for r in model.own.collect():
        own.setdefault(r["a"], {})[r["b"]] = r
    code = {int(h): k for k, h in enumerate(a.hashes)}
    hash_of = lambda w: language.xxhash.xxh3_64_intdigest(w.encode()) >> 1
    at = lambda w: code.get(hash_of(w), -1 - hash_of(w))
    counts = {r["key"]: r["value"] for r in model.rare.collect()}
    seated = {r["key"]: r["value"] for r in model.pairs.collect()} | dict(zip(a.pairs.tolist(), a.seated.tolist(), strict=True))
    pairs = Counter()
    for i, text, _ in documents:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            ks = [a.rare + 1, *map(at, tokens_of(text))]
            pairs.update((x, y) for x, y in zip(ks, ks[1:], strict=False) if x < 0 or y < 0)
    assert {(x, y) for x in own for y in own[x]} == set(pairs) and len([x for x in own if x < 0]) == len(counts) > 100

    def class_of(before, k):
        x, y = (a.rare if before < 0 else before), (a.rare if k < 0 else k)
        return seated.get(x << 32 | y, 0.0) / (a.strength + a.totals[x]) + np.mean([g[x] * r[y] for g, r in zip(a.mass, a.parent, strict=True)])

    def chance(before, k):
        share = (counts.get(k, 0) + 1) / a.rare_size if k < 0 else 1.0
        if before >= 0 and k >= 0:
            return class_of(before, k)
        base = class_of(before, k) * share if before < 0 else share
        some = own.get(before, {})
        if not some:
            return class_of(before, k) * share
        size, rest = next((r["size"], r["rest"]) for r in some.values())
        p = ((some[k]["seated"] if k in some else 0.0) + rest * base) / size
        return p if before < 0 else class_of(before, k) * p

    for before, some in own.items():
        size, rest = next((r["size"], r["rest"]) for r in some.values())
        assert size == a.strength + sum(n for (x, _), n in pairs.items() if x == before)
        assert sum(r["seated"] for r in some.values()) + rest == pytest.approx(size)
    u, v = [x for x in own if x < 0][:2]
    total = lambda before: sum(chance(before, k) for k in [*range(a.rare), *counts, -1])  # noqa: E731  -1 - h of no word: the unseen one
    assert total(u) == pytest.approx(1) and total(v) == pytest.approx(1) and total(a.rare + 1) == pytest.approx(1)
    assert any(abs(chance(u, k) / chance(v, k) - 1) > 0.1 for k in own[u])
    found = {r["doc_id"]: r["score"] for r in language.scored(docs, model).collect()}
    for i, text, _ in documents:
        ks = [a.rare + 1, *map(at, tokens_of(text))]
        assert found[i] == pytest.approx(sum(math.log10(chance(x, y)) for x, y in zip(ks, ks[1:], strict=False)), abs=1e-6)


def test_keys_are_looked_up_in_waves_of_packed_chunks(spark, own_model):
    """No row a token is shuffled: a chunk of texts has a row a bucket and wave at most, the waves ask for each key once, and their number changes no score."""
    docs, model = own_model
    rows = docs.select("doc_id", F.lit(True).alias("learn"), "text").repartition(2)
    coded = language._coded(rows, spark.sparkContext.broadcast(model.arrays.hashes), model.settings).cache()
    shared, chunks, asked = spark.sparkContext.broadcast(model.arrays), coded.count(), {}
    for waves in (1, 4):
        found = [r for k in range(waves) for r in language._asked(coded, shared, replace(model.settings, waves=waves), k, 3).collect()]
        assert len(found) <= chunks * (3 * waves + 1)
        asked[waves] = Counter(k for r in found if r["keys"] for k in np.cumsum(language._unpacked(r["keys"], np.int64)[0]).tolist())
    assert asked[1] == asked[4] and asked[1].total() > 100 * chunks
    scores = [sorted((r["doc_id"], r["n_known"], round(r["score"], 6)) for r in language.scored(docs, replace(model, settings=replace(model.settings, waves=waves))).collect()) for waves in (1, 4)]
    assert scores[0] == scores[1]


def test_pairs_lie_packed_in_their_buckets(own_model, documents):
    """No row a pair: a bucket has two rows at most here, and the rows hold every pair of the training texts with its count."""
    model = own_model[1]
    a, rows = model.arrays, model.packed.collect()
    code = {int(h): k for k, h in enumerate(a.hashes)}
    pairs = Counter()
    for i, text, _ in documents:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            ks = [a.rare + 1, *(code.get(language.xxhash.xxh3_64_intdigest(w.encode()) >> 1, a.rare) for w in tokens_of(text))]
            pairs.update(x << 32 | y for x, y in zip(ks, ks[1:], strict=False))
    found = {}
    for r in rows:
        keys = np.cumsum(language._unpacked(r["keys"], np.int64)[0])
        assert (language._bucket(keys, model.buckets) == r["bucket"]).all() and (np.diff(keys) > 0).all()
        found |= dict(zip(keys.tolist(), language._unpacked(r["c"], np.int64)[0].tolist() if r["c"] else [1] * len(keys), strict=True))
    assert found == pairs and len(rows) <= 2 * model.buckets < len(pairs)


def test_model_is_better_than_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = language.fit(docs.filter(~language.is_held_out(F.col("doc_id"))))
    held = language.scored(docs.filter(language.is_held_out(F.col("doc_id"))), model)
    ours, base, n = held.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert ours / n > base / n + 0.5  # less than a third of the base's perplexity
    assert language.perplexity(held.withColumn("all", F.lit(1)), "all").first()["perplexity"] == pytest.approx(10 ** (-ours / n))


def test_gibbs_draws_tables_by_the_seating_rule():
    """Shares of table counts of one dish with few customers, after many sweeps, against the exact distribution over all seatings."""
    d, strength, base, others, c = 0.6, 1.0, 0.3, 4, 5

    def partitions(n):  # set partitions of n customers, as sizes, by sitting down one after another
        if n == 1:
            return {(1,): 1}
        out = Counter()
        for sizes, k in partitions(n - 1).items():
            out[(*sizes, 1)] += k
            for i in range(len(sizes)):
                out[(*sizes[:i], sizes[i] + 1, *sizes[i + 1 :])] += k
        return out

    weight = Counter()
    for sizes, k in partitions(c).items():
        t = len(sizes)
        opened = math.prod((strength + d * (others + j)) * base for j in range(t))
        weight[t] += k * opened * math.prod(math.prod(j - d for j in range(1, s)) for s in sizes)
    n = 20_000
    key, full = np.arange(n), lambda x: np.full(n, x)
    tables, sizes = full(1), full(c)
    for turn in range(6):
        tables, sizes = language.sweep(key, full(c), tables, sizes, full(others), full(base), d, strength, 8, 1, turn)
    assert sizes.sum() == n * c and (np.add.reduceat(sizes, np.cumsum(tables) - tables) == c).all()
    got = np.bincount(tables, minlength=c + 1)[1:] / n
    assert got == pytest.approx([weight[t] / weight.total() for t in range(1, c + 1)], abs=0.015)


def test_language_model_of_nothing_and_one_text(spark, no_documents, odd):
    model = language.fit(no_documents)
    found = language.scored(odd, model).collect()
    assert len(found) == odd.count() and all(r["n_known"] == 0 and r["score"] == pytest.approx(0) for r in found)  # each word is the one unseen word
    assert language.scored(no_documents, model).count() == 0
    one = language.fit(odd.filter("doc_id = 4"))
    assert one.arrays.tokens == 2 and language.scored(odd.filter("doc_id = 5"), one).first()["n_known"] == 2


def test_places_of_keys():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 50, n))
        asked = np.concatenate([keys, rng.integers(0, 1 << 50, 5000), -keys - 1])
        at = language._Places(keys).of(asked)
        assert (at[: len(keys)] == np.arange(len(keys))).all()
        there = {int(k): i for i, k in enumerate(keys)}
        assert at.tolist() == [there.get(int(k), -1) for k in asked]


def test_seating_of_great_counts():
    c, others = np.array([10**9, 2, 50]), np.array([1000, 0, 10])
    tables, sizes = language.first_seating(c, others, np.array([0.1, 0.001, 0.5]), 0.7, 1.0)
    tables, sizes = language.sweep(np.arange(3), c, tables, sizes, others, np.array([0.1, 0.001, 0.5]), 0.7, 1.0, 8, 1)
    assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == c).all() and (sizes > 0).all() and tables[0] > tables[2] > tables[1] - 1
