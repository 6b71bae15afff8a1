"""The pipeline's stages on the small table, each against plain Python on its own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from riverlog.llm import mixing, packing, secrets
from riverlog.llm.common import Scratch

from .test_linking import plain_components
from .test_texts import check_packing, count, plain_quality, plain_targets


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """What goes into each stage, and what comes out of the last."""
    scratch, docs, out = Scratch(spark, "test"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return [*out, docs]


def texts(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "mix_sources", "best_fit_packing"]
    assert all(x.columns == steps[0].columns for x in steps[:5])


def test_rejected_documents_go_and_trusted_ones_stay(spark, sf_dir, steps):
    before, after = (dict((i, t) for i, t, _ in texts(x)) for x in steps[:2])
    assert set(after) < set(before)
    for t in after.values():
        n, *_, repeated = plain_quality(t)
        assert n >= 50 and 100 * repeated <= 50 * n
    sound = {i for i, t in before.items() if plain_quality(t)[0] >= 50 and 100 * plain_quality(t)[4] <= 50 * plain_quality(t)[0]}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and coalesce(toxic, 0) = 0").collect()} & sound
    assert len(good & set(after)) >= 0.95 * len(good)


def test_one_document_of_each_group_stays(steps):
    before, after = texts(steps[1]), texts(steps[2])
    component, _ = plain_components(before, 5)
    assert sorted(i for i, *_ in after) == sorted(i for i, c in component.items() if i == c)


def test_secrets_are_marked(spark, sf_dir, steps):
    before, after = ({i: t for i, t, _ in texts(x)} for x in steps[2:4])
    assert set(before) == set(after)
    assert all(after[i] == secrets.redact(t) for i, t in before.items())
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3].collect())
    one = spark.createDataFrame([(1, "my password: hunter22x, really", "en", "a", 30)], steps[2].schema)
    assert tuple(corpus_pipeline.redact(spark, one, sf_dir).first()) == (1, "my [SECRET], really", "en", "a", 19)


def test_sources_meet_their_targets(steps):
    before, after = texts(steps[3]), texts(steps[4])
    sizes, taken, by_id = Counter(), Counter(), {i: count(t) for i, t, _ in before}
    for _, t, s in before:
        sizes[s] += count(t)
    for i, t, s in after:
        taken[s] += count(t)
        assert count(t) <= by_id[i]
    target = plain_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert max(Counter(i for i, *_ in after).values()) <= 2


def test_sequences_hold_all_tokens(steps):
    rows = steps[5].collect()
    check_packing(rows, 2048)
    encode = packing.encoder(packing.PackSettings().tokenizer, None)
    want, got = Counter(), defaultdict(list)
    for i, t, _ in texts(steps[4]):
        want[i] += len(encode(t)) + 1
    for r in rows:
        got[r["doc_id"]].append(r["length"])
    assert {i: sum(x) for i, x in got.items()} == dict(want)


def test_run_is_the_stages_one_after_another(spark, sf_dir, steps):
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(key, steps[5].collect()))


def test_shards_are_even_for_even_documents(spark):
    docs = spark.createDataFrame([(i, "word " * 50, "abc"[i % 3]) for i in range(1200)], "doc_id long, text string, source string")
    words = Counter()
    for r in mixing.mix(docs, mixing.MixSettings(block_words=500, shard_words=4000)).collect():
        words[r["mix_shard"]] += r["mix_words"]
    assert len(words) > 4 and max(words.values()) < 3 * min(words.values())


def test_crc_is_that_of_the_ids(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    row = packing.pack(docs, with_ids=True).first()
    assert row["ids_crc32"] == zlib.crc32(np.array(row["ids"], dtype="<u4").tobytes())


def test_stages_on_odd_rows(spark, sf_dir, odd_documents, no_documents):
    words = " ".join(f"word{i}" for i in range(80))
    rows = [*odd_documents, (20, words, "a"), (20, words, "a"), (21, words + " tail", None), (22, words.replace("word7 ", "other "), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("doc_id", "text", "'x' AS lang", "source", "CAST(length(text) AS BIGINT) AS n_chars", "1 AS size", "2 AS label", "3 AS kept", "4 AS mix_pass", "5 AS _verdict_", "6 AS _rest_")
    out = {name: stage(spark, docs, sf_dir).collect() for name, stage in corpus_pipeline.STAGES}
    for name, found in out.items():
        if name != "best_fit_packing":
            assert all((r["size"], r["label"], r["kept"], r["mix_pass"], r["_verdict_"], r["_rest_"]) == (1, 2, 3, 4, 5, 6) for r in found) and found[0].__fields__ == docs.columns
    assert all(plain_quality(r["text"])[0] >= 50 for r in out["quality_rules"])
    component, _ = plain_components(rows, 5)
    assert Counter(r["doc_id"] for r in out["near_dedup"]) == Counter(i for i, *_ in rows if i is None or component[i] == i)
    assert Counter((r["doc_id"], r["text"]) for r in out["secret_scan"]) == Counter((i, secrets.redact(t)) for i, t, _ in rows)
    assert all(count(r["text"]) for r in out["mix_sources"])
    assert sum(r["piece"] == 0 for r in out["best_fit_packing"]) == len(rows)
    empty = docs.limit(0)
    assert all(stage(spark, empty, sf_dir).collect() == [] for _, stage in corpus_pipeline.STAGES)
