"""What operators share: rows with extra columns of clashing names, and plain versions of scores and thresholds."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverlog.llm import conversations, language, lines, mixing, neardup, neighbours, packing, privacy, quality, resampling, secrets, substrings, warc
from riverlog.llm.common import Scratch

NAMES = (
    "rank", "lang", "size", "label", "kept", "row", "key", "own", "value", "n", "p", "q", "print", "start", "end", "number", "later", "copy", "place", "block", "turns", "audit", "spans", "personal", "secrets", "quality", "score",
    "weight", "n_words", "n_features", "has_id", "component_id", "pivot", "source_no", "target", "taken", "draws", "mix_pass", "length", "sequence_id", "offset", "piece", "sha", "refers_to", "is_revisit", "salt", "tables", "c", "w", "h",
)


def crowded(rows):
    return rows.withColumns({c: F.lit(i) for i, c in enumerate(NAMES) if c not in rows.columns})


OPERATORS = {
    "mix": lambda d: mixing.assign(d).select("id", "size", "source_size", "target", "taken"),
    "lines": lambda d: lines.remove_repeated_units(d).select("doc_id", "n_units", "n_removed", "kept"),
    "neardup": lambda d: neardup.near_components(d).select("doc_id", "component_id"),
    "privacy": lambda d: privacy.find_personal(d).select("doc_id", F.size("personal")),
    "secrets": lambda d: secrets.find_secrets(d).select("doc_id", F.size("secrets")),
    "packing": lambda d: packing.pack(d).select("doc_id", "piece", "start", "ids_crc32"),
    "substrings": lambda d: substrings.remove_repeats(d).select("doc_id", "n_removed", "n_spans"),
    "quality": lambda d: quality.judge(d, quality.fit(d, d.sparkSession.createDataFrame([(6, 1, 0), (12, 0, 0)], "doc_id long, quality int, toxic int"))).select("doc_id", "quality.n_words", "quality.kept"),
    "resampling": lambda d: resampling.ranked(d, d.limit(3)).select("doc_id", "weight", "score", "rank"),
    "language": lambda d: language.scored(d, language.fit(d)).select("doc_id", "n_tokens", "n_known", F.round("score", 6)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_of_clashing_names_change_nothing(odd, name):
    plain = odd.select("doc_id", "text", "source")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(OPERATORS[name](crowded(plain))) == rows(OPERATORS[name](plain))


def test_clashing_names_of_other_tables(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11), 1.0]) for i in range(300)], "vec_id long, v array<double>")
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, None, None)], "page_id long, url string, html string")
    turns = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "No"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    for table, f in (
        (pages, lambda d: warc.round_trip(d).select("record_id", "record_type", "payload_digest")),
        (turns, lambda d: conversations.repaired(conversations.damaged(d))),
        (vectors, lambda d: neighbours.search(d, F.col("vec_id") % 50 == 0)),
    ):
        assert rows(f(crowded(table))) == rows(f(table))


def plain_grams(text, bits):
    """Buckets of the three-byte windows within a word and its borders, a byte of each word in the middle of one."""
    out = []
    for word in text.encode().split():
        data = b" " + word + b" "
        out += [(((data[i - 1] << 16 | data[i] << 8 | data[i + 1]) * 0x9E3779B97F4A7C15) % 2**64) >> (64 - bits) for i in range(1, len(data) - 1)]
    return out


def test_quality_scores_and_threshold_by_plain_python(spark, documents):
    s = quality.QualitySettings(bits=10)
    rows = [(i, t or "") for i, t, _ in documents]
    labels = [(i, int(i % 3 > 0), 0) for i, _ in rows if i % 2 == 0]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), s)
    order = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i, _ in rows], "i long").select("i", F.xxhash64("i").alias("h")).collect()}
    ranked = lambda q: sorted((i for i, k, _ in labels if k == q), key=lambda i: (order[i], i))
    trusted, held, rejected = ranked(1)[::2], ranked(1)[1::2], ranked(0)
    text = dict(rows)
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(plain_grams(t, s.bits))
        if i in trusted:
            good.update(plain_grams(t, s.bits))
    size = 1 << s.bits
    ratio = [math.log((good[b] + 1) / (good.total() + size)) - math.log((raw[b] + 1) / (raw.total() + size)) for b in range(size)]
    score = lambda t: sum(ratio[b] for b in g) / len(g) if (g := plain_grams(t, s.bits)) else 0.0
    assert model.ratios == pytest.approx(ratio)
    mine = {i: score(t) for i, t in rows}
    most = sorted(mine[i] for i in held)[int((1 - s.keep) * len(held))]
    values = sorted({mine[i] for i in (*held, *rejected)})
    cuts = sorted([c for c in [*((a + b) / 2 for a, b in zip(values, values[1:])), most] if c <= most])
    balance = lambda c: sum(mine[i] >= c for i in held) / len(held) + sum(mine[i] < c for i in rejected) / len(rejected)
    assert balance(model.threshold) == pytest.approx(max(map(balance, cuts))) and model.threshold <= most + 1e-12
    for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        q = r["quality"]
        assert q["score"] == pytest.approx(mine[r["doc_id"]], abs=1e-9)
        assert q["kept"] == (not q["base_failed"] and q["score"] >= model.threshold)
    assert np.isfinite(model.threshold) and text


def test_shuffles_of_a_scratch_table_go_once_it_is_written(spark):
    tracker, key = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffled():
        files = tracker.getAllFiles()
        return {name for i in range(files.length()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before, was = shuffled(), spark.conf.get(key)
    table = Scratch(spark, "test").table(spark.range(50_000).selectExpr("id % 1000 AS k").groupBy("k").count(), "counts")
    for _ in range(100):  # files are removed beside the driver's thread
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 1000 and spark.conf.get(key) == was
