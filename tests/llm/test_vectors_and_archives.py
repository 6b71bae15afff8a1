"""Neighbours against brute force, archives as a round trip and after damage."""

import base64
import gzip
import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverlog.llm import neighbours, queries, warc
from tests.compare import assert_same

AT = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, v array<double>"


def brute_force(vectors, queries, k=10):
    """query -> [(distance, vec_id)]; vectors by id."""
    ids = sorted(vectors)
    data = np.array([vectors[i] for i in ids], dtype=np.float64)
    out = {}
    for q in queries:
        far = np.sqrt(((data - np.array(vectors[q], dtype=np.float64)) ** 2).sum(1))
        out[q] = sorted((float(d), i) for d, i in zip(far, ids) if i != q)[:k]
    return out


def test_recall_against_brute_force(spark):
    vectors = {r[0]: r[1] for r in spark.read.parquet(f"{AT}/embeddings.parquet").select("vec_id", "embedding").collect() if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])}
    want = brute_force(vectors, [i for i in vectors if i % 100 == 0])
    got = neighbours.op4_hilbert_neighbours(spark, AT).collect()
    hits = total = 0
    for q, best in want.items():
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(best) + 1))
        assert [(r["score"], r["vec_id"]) for r in rows] == sorted((r["score"], r["vec_id"]) for r in rows)
        for r in rows:
            assert r["score"] == pytest.approx(math.dist(vectors[q], vectors[r["vec_id"]]), rel=1e-12)
        hits += len({r["vec_id"] for r in rows} & {i for _, i in best})
        total += len(best)
    assert hits / total >= 0.9


def test_recall_with_a_window_below_a_tenth_of_the_index(spark):
    at = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    vectors = {r[0]: r[1] for r in table.collect() if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])}
    settings = neighbours.CurveSettings(window=64)
    assert max(settings.window, settings.share * len(vectors)) < len(vectors) / 10
    want = brute_force(vectors, [i for i in vectors if i % 100 == 0])
    got = {}
    for r in neighbours.search(table, F.col("vec_id") % 100 == 0, settings).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {i for _, i in best}) / len(best) for q, best in want.items()]) >= 0.9


def test_double_vectors_stay_double(spark):
    rows = [(100, [1.0, 0.0]), (1, [1 + 1e-9, 0.0]), (2, [1e200, 1.0]), (3, [0.0, 1e-200]), (4, [3e-200, 0.0])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS query", "2 AS rep", "3 AS score")
    got = {r["vec_id"]: r["score"] for r in neighbours.search(docs, "vec_id % 100 = 0").collect()}
    assert got == {i: math.dist(v, rows[0][1]) for i, v in rows[1:]}
    tiny = {r["vec_id"]: r["score"] for r in neighbours.search(docs, "vec_id = 3").collect()}
    assert tiny[4] == pytest.approx(math.sqrt(10) * 1e-200)


def test_small_and_odd_vectors_are_exact(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [2.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (200, [3.0, 3.0, 3.0]), (300, [0.0, 0.0])]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), "vec_id % 100 = 0").collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(100, 1, 1, 0.0), (100, 2, 2, 0.0), (100, 3, 4, 1.0), (100, 4, 3, math.sqrt(2))]
    assert neighbours.search(spark.createDataFrame([], SCHEMA), "vec_id % 100 = 0").collect() == []


def test_many_equal_vectors_keep_the_least_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(i), 0.0, 1.0]) for i in range(50)]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), "vec_id = 300 or vec_id = 3").collect()
    for q in (3, 300):
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in rows] == [i for i in range(12) if i != q][:10]


def test_repeats_of_a_row_leave_room_for_other_ids(spark):
    salts = {r["id"]: r["salt"] for r in spark.range(1, 2000).selectExpr("id", "pmod(xxhash64(id), 64) AS salt").collect()}
    other = next(i for i in range(2, 2000) if salts[i] == salts[1])
    rows = [(1, [1.0, 2.0])] * 20 + [(other, [1.0, 2.0])]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), "vec_id = 1").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, other, 0.0)]


def test_hilbert_neighbours_on_the_curve_are_neighbours_in_space():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/", "x" * 300), (2, "http://b/\r\nWARC-Type: x", "x" * 300), (7, None, "x" * 300), (3, "http://é/", None), (4, "http://c/", ""), (5, "http://d/", "WARC/1.1\r\n\r\n\x1f\x8b\x08 é"), (None, "http://e/", "own"), (6, "u", "y" * 2_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    got = {r["record_id"]: r for r in warc.round_trip(pages).collect() if r["kind"] == "record"}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        r, payload = got[warc.record_id(page_id)], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        response = {1: 7, 2: 7, 3: 4}.get(page_id)
        assert (r["record_type"], r["refers_to"]) == (("revisit", warc.record_id(response)) if response else ("response", None))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).collect() == []


def test_smaller_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = warc.round_trip(pages, warc.WarcSettings(min_bytes=3)).collect()
    assert sorted((r["record_id"][-2], r["record_type"]) for r in got) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]


RECORDS = [warc.record(i, f"http://p/{i}", f"page {i} ".encode() * 50, None, False) for i in range(5)]


def found(data):
    return [(kind, start, end, h and h["warc-record-id"]) for kind, start, end, h, _ in warc.salvage(data)]


def ids(data):
    return [i for kind, *_, i in found(data) if kind == "record"]


@pytest.mark.parametrize("pack", [lambda x: x, lambda x: gzip.compress(x, mtime=0)])
def test_salvage_after_damage(pack):
    parts = [pack(r) for r in RECORDS]
    whole, edge = b"".join(parts), [0]
    for p in parts:
        edge.append(edge[-1] + len(p))
    names = [warc.record_id(i) for i in range(5)]
    assert ids(whole) == names and not [x for x in found(whole) if x[0] == "gap"]
    hurt = bytearray(whole)
    middle = (edge[1] + edge[2]) // 2
    hurt[middle : middle + 4] = b"\0\0\0\0"
    assert ids(bytes(hurt)) == [names[0], *names[2:]]
    assert [x[:3] for x in found(bytes(hurt)) if x[0] == "gap"] == [("gap", edge[1], edge[2])]
    cut = whole[: edge[4] + 20]
    assert ids(cut) == names[:4] and found(cut)[-1][:3] == ("gap", edge[4], len(cut))
    noise = b"noise" + whole
    assert ids(noise) == names and found(noise)[0][:3] == ("gap", 0, 5)
    assert found(b"") == [] and found(b"only noise") == [("gap", 0, 10, None)]


def test_long_heads_are_no_damage(spark):
    urls = {1: "http://x/" + "a" * 2_000_000, 2: "http://x/" + "\x01" * 700_000, 3: "http://x/WARC/1.1"}
    rows = [(i, u, f"page {i}") for i, u in urls.items()]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r["record_id"], r["kind"], r["url"]) for r in got} == {(warc.record_id(i), "record", u.replace("\x01", "%01")) for i, u in urls.items()}
    cut = warc.record(1, urls[1], b"", None, False)[:1_500_000] + b"\r\n" + warc.record(2, "http://y", b"b", None, False)
    assert [(k, h and h["warc-target-uri"]) for k, _, _, h, _ in warc.salvage(cut)] == [("gap", None), ("record", "http://y")]


def test_salvage_inside_a_member_of_many_records():
    data = gzip.compress(RECORDS[0] + b"??" + RECORDS[1], mtime=0) + gzip.compress(RECORDS[2], mtime=0)
    assert ids(data) == [warc.record_id(i) for i in range(3)]
    assert [x[0] for x in found(data)].count("gap") == 1


def test_damaged_and_cut_members_give_the_records_before_the_damage():
    rng = np.random.default_rng(1)
    records = [warc.record(i, f"http://p/{i}", rng.integers(32, 127, 3000, dtype=np.uint8).tobytes(), None, False) for i in range(20)]
    names = [warc.record_id(i) for i in range(20)]
    member = gzip.compress(b"".join(records), mtime=0)
    cut = member[: len(member) * 3 // 4]
    assert 14 <= len(ids(cut)) <= 15 and ids(cut) == names[: len(ids(cut))]
    hurt = bytearray(member)
    hurt[len(member) // 2 : len(member) // 2 + 40] = b"\xff" * 40
    got = ids(bytes(hurt))
    assert got[:9] == names[:9] and len(set(got)) == len(got)
    after = ids(cut + gzip.compress(RECORDS[0], mtime=0))
    assert after == [*ids(cut), names[0]]
    gaps = [x for x in found(cut) if x[0] == "gap"]
    assert len(gaps) == 1 and 0 < gaps[0][1] < gaps[0][2] == len(cut)


def test_folded_headers_and_bombs():
    folded = RECORDS[0].replace(b"WARC-Date: ", b"WARC-Note: one\r\n  two\r\nWARC-Date: ")
    assert [h["warc-note"] for *_, h, _ in warc.salvage(folded)] == ["one two"]
    bomb = gzip.compress(bytes(1 << 24), mtime=0)
    assert ids(b"x" + bomb * 3 + gzip.compress(RECORDS[1], mtime=0)) == [warc.record_id(1)]


def test_junk_of_any_length_before_the_first_version_line():
    names = [warc.record_id(i) for i in (0, 1)]
    for junk in (b"j" * 200_000, b"WARC/1.1\r\n" * 20_000, bytes(3_000_000)):
        member = gzip.compress(junk + RECORDS[0] + RECORDS[1], mtime=0)
        assert ids(member) == names and ids(b"damage" + member) == names and ids(member[:-9]) == names
        assert [x[0] for x in found(b"damage" + member)] == ["gap", "record", "record"]


def test_members_larger_than_what_is_held(monkeypatch):
    monkeypatch.setattr(warc, "HOLD", 100_000)
    monkeypatch.setattr(warc, "CHUNK", 5_000)
    many = [warc.record(i, f"http://p/{i}", f"page {i} ".encode() * 500, None, False) for i in range(200)]
    names = [warc.record_id(i) for i in range(200)]
    member = gzip.compress(b"".join(many), mtime=0)
    assert ids(member) == names and not [x for x in found(member) if x[0] == "gap"]
    assert ids(b"??" + member + gzip.compress(RECORDS[1], mtime=0)) == [*names, names[1]]
    assert [x[:3] for x in found(b"??" + member)][0] == ("gap", 0, 2)
    hurt = gzip.compress(b"".join([*many[:150], b"between", *many[150:]]), mtime=0)
    assert ids(hurt) == names and [x[0] for x in found(hurt)].count("gap") == 1
    big = warc.record(5, "http://p/5", bytes(3_000_000), None, False)
    assert ids(gzip.compress(many[0] + big + many[1], mtime=0)) == [names[0], names[5], names[1]]


def test_false_version_lines_take_linear_time():
    false = b"WARC/1.1\r\n" + b"x" * 30 + b"\r\n"
    data = false * (2_000_000 // len(false))
    start = time.process_time()
    assert ids(data + RECORDS[0]) == [warc.record_id(0)] and ids(gzip.compress(data + RECORDS[0])) == [warc.record_id(0)]
    magic = (b"\x1f\x8b\x08" + b"y" * 40) * 20_000
    assert ids(magic + RECORDS[1]) == [warc.record_id(1)]
    claims = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % (10**12 + i) for i in range(20_000))
    assert ids(gzip.compress(claims + RECORDS[2])) == [warc.record_id(2)] and ids(claims + RECORDS[2]) == [warc.record_id(2)]
    assert time.process_time() - start < 20


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert assert_same(queries.queries()[name](spark, AT), AT, queries.oracle_sql()[name])
