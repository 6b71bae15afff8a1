"""Near-dedup, lines and repeated windows against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverlog.llm import graph, lines, neardup, substrings
from riverlog.llm.common import Scratch


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(zip(*[words[i:] for i in range(k)]))


def plain_components(rows, k, percent=80):
    """doc_id -> least doc_id reachable; every pair of different sets is compared."""
    sets = [(i, shingles(t, k)) for i, t, *_ in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
                lo, hi = sorted((top(i), top(j)))
                up[hi] = lo
    return {i: top(i) for i in up}, {i: len(s) for i, s in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_components_are_those_of_all_pairs(spark, documents, k):
    docs = spark.createDataFrame(documents, "doc_id long, text string, source string")
    want, sizes = plain_components(documents, k)
    got = neardup.near_components(docs, neardup.NearSettings(words=k)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_drifting_copies_are_one_component(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # each differs from the one before in one place, the last ones from the first in half
        base = [*base]
        base[(i * 2) % 120] = f"new{i}"
        rows.append((i, " ".join(base), "s"))
    got = neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string, source string"), neardup.NearSettings(words=2)).collect()
    want, _ = plain_components(rows, 2)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) == 1


def test_near_dedup_of_odd_rows(odd, odd_documents, no_documents):
    got = neardup.near_components(odd, neardup.NearSettings(words=2)).collect()
    assert len(got) == len(odd_documents)
    want, sizes = plain_components(odd_documents, 2)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], sizes[r["doc_id"]])
    assert want[5] == 4  # equal but for A-Z
    assert neardup.near_components(no_documents).collect() == []


def test_floor_is_nearly_never_missed():
    assert neardup.floor_of(64, 80, 1e-6) in range(30, 40)
    assert neardup.floor_of(1, 100, 1e-6) == 1


def plain_windows(rows, w):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        keep = bytearray(b"\1" * len(t))
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                keep[i : i + w] = bytes(w)
        spans = sum(not k and (i == 0 or keep[i - 1]) for i, k in enumerate(keep))
        out.append((len(t), len(t) - sum(keep), spans, hashlib.sha256(bytes(b for b, k in zip(t, keep) if k)).hexdigest()))
    return out


@pytest.mark.parametrize("split_over", [1, 200])
def test_windows_are_those_that_occur_again(spark, documents, split_over):
    rows = documents[:120]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in substrings.remove_repeats(docs, substrings.WindowSettings(split_over=split_over)).collect()}
    assert got == dict(zip([r[0] for r in rows], plain_windows(rows, 200)))


def test_windows_of_odd_rows(odd, odd_documents, no_documents):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in substrings.remove_repeats(odd).collect()))
    want = sorted((i is None, i or 0, *x) for (i, *_), x in zip(odd_documents, plain_windows(odd_documents, 200)))
    assert got == want
    assert substrings.remove_repeats(no_documents).collect() == []


def test_passages_inside_other_lines_go_but_for_the_first(spark):
    passage = "Here is one long sentence that stands in many places. And a second sentence of it follows on."
    rows = [(i, f"Own words number {i} are here at first. {passage} Own words number {i} are here at last.", "s") for i in range(5)]
    got = {r["doc_id"]: r for r in lines.remove_repeated_units(spark.createDataFrame(rows, "doc_id long, text string, source string"), lines.LineSettings(unit="sentence", run_words=20)).collect()}
    assert [got[i]["n_removed"] for i in range(5)] == [0, 0, 0, 0, 0]  # two sentences of 18 words are no passage yet
    got = {r["doc_id"]: r for r in lines.remove_repeated_units(spark.createDataFrame(rows, "doc_id long, text string, source string"), lines.LineSettings(unit="sentence", run_words=15)).collect()}
    assert [got[i]["n_removed"] for i in range(5)] == [0, 2, 2, 2, 2]
    for i in range(1, 5):
        assert "".join(rows[i][1][s["start"] : s["end"]] for s in got[i]["spans"]).strip() == passage
        assert got[i]["kept"] == f"Own words number {i} are here at first. Own words number {i} are here at last."


def test_lines_of_odd_rows(odd, odd_documents, no_documents):
    got = lines.remove_repeated_units(odd).collect()
    assert len(got) == len(odd_documents)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[None][0]["n_removed"] == 0 and by[6][0]["kept"] == ""  # rows without id come first
    assert by[1][0]["n_units"] == 0 and by[4][0]["kept"] == "one"
    assert sorted(len(r["kept"]) for r in by[7]) == [0, 0]
    assert lines.remove_repeated_units(no_documents).collect() == []
    assert lines.remove_repeated_units(odd, lines.LineSettings(unit="paragraph")).count() == len(odd_documents)


def test_every_later_line_goes(spark):
    rows = [(1, "all rights reserved.\nown one\n"), (2, "own two\nAll  rights reserved.\n"), (3, "own three"), (3, "own three"), (None, "own three"), (None, "OWN two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["kept"]) for r in lines.remove_repeated_units(docs).collect())
    assert got == [("1", "all rights reserved.\nown one\n"), ("2", ""), ("3", ""), ("3", ""), ("None", "OWN two"), ("None", "own three")]


def test_later_paragraphs_go(spark):
    rows = [(1, "one a\none b\n\ntwo\n\n\nthree"), (2, "two\n\nOne  A\none b\n\nown"), (3, "one a\n\none b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("p", "print", "later", "copy", "number")})
    got = {r["doc_id"]: (r["kept"], [tuple(s) for s in r["spans"]]) for r in lines.remove_repeated_units(docs, lines.LineSettings(unit="paragraph")).collect()}
    assert got == {1: (rows[0][1], []), 2: ("own", [(0, 5), (5, 19)]), 3: (rows[2][1], [])}


def test_one_of_equal_rows_is_the_earliest(spark):
    rows = [(1, "this is a passage of words " * 5)] * 3 + [(2, "this is a passage of words " * 5)]
    got = sorted((r["doc_id"], len(r["kept"])) for r in lines.remove_repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (1, len(rows[0][1])), (2, 0)]


def test_equal_digits_of_different_bytes_are_parted():
    data = np.frombuffer(b"abcdefghij" * 3 + b"abcdefghiX" + b"zzzzzzzzzz", np.uint8)
    at, digit = np.array([0, 10, 30, 20, 40, 1]), np.array([5, 5, 5, 5, 5, 7], dtype=np.uint64)
    assert substrings.equal_windows(data, at, digit, 10).tolist() == [True, True, False, True, False, False]


def least_nodes(links):
    """node -> least node reachable, a link at a time."""
    label = {x: x for pair in links for x in pair}
    for a, b in links:
        lo, hi = sorted((label[a], label[b]))
        label = {x: lo if y == hi else y for x, y in label.items()} if lo != hi else label
    return label


@pytest.mark.parametrize("block", [5, 64, 1 << 20])
def test_links_of_chains_stars_and_rings_give_their_least_node_in_blocks_of_any_size(spark, block):
    rng = random.Random(block)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 240)] + [(300 + i, 300 + (i + 1) % 30) for i in range(30)] + [(239, -7), (5, 5)]
    links += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(60)]
    rng.shuffle(links)
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(4), Scratch(spark, "test"), block).collect()
    assert {r["node"]: r["label"] for r in got} == least_nodes(links) and len(got) == len(least_nodes(links))


def test_a_long_chain_takes_no_more_jobs_than_a_short_one(spark):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"chain{n}", "")
        links = Scratch(spark, "test").table(spark.range(n).selectExpr("id AS a", "id + 1 AS b"), "chain")
        assert graph.components(links, Scratch(spark, "test")).filter("label = 0").count() == n + 1
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain{n}"))

    try:
        assert jobs(3000) == jobs(3)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
