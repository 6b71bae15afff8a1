"""Mixing, secrets, personal data, packing and quality against plain Python."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverlog.llm import mixing, packing, privacy, quality, secrets, tagger
from riverlog.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LUHN = "4000001234567899"


def count(text):
    return len(WORD.findall(text or ""))


def plain_targets(sizes):
    """Reshares what is over twice a source's size by weight until no source is above."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    got, free, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            got[s] += left * weight[s] / total
        left = sum(max(0, got[s] - 2 * sizes[s]) for s in free)
        full = {s for s in free if got[s] >= 2 * sizes[s]}
        for s in full:
            got[s] = 2.0 * sizes[s]
        free -= full
    return got


def test_mix_meets_targets(spark, sf_dir, documents):
    got = mixing.op1_mix_sources(spark, sf_dir).collect()
    source = {i: s for i, _, s in documents}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert target == pytest.approx(plain_targets(sizes))
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op1_mix_sources(spark, sf_dir).collect()))


def test_mix_rows_are_the_draws(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string, source string")
    settings = mixing.MixSettings(block_words=500, shard_words=4000)
    rows = mixing.mix(docs, settings).collect()
    assert all(count(r["text"]) == r["mix_words"] for r in rows)
    assert len({r["mix_shard"] for r in rows}) > 4
    taken = Counter()
    for r in rows:
        taken[r["doc_id"]] += r["mix_words"]
    assert {r["id"]: r["taken"] for r in mixing.assign(docs, settings).collect() if r["taken"]} == taken


def test_splitting_tree_keeps_quotas(spark):
    quotas = [700, 3, 0, 250, 41]
    leaves = mixing.splitting_tree(spark.createDataFrame([(quotas,)], "quotas array<long>"), 3, 11, Scratch(spark, "test")).collect()
    assert len(leaves) == 8
    assert [sum(x) for x in zip(*(r["quotas"] for r in leaves))] == quotas
    sizes = [sum(r["quotas"]) for r in leaves]
    assert max(sizes) - min(sizes) <= 1
    big = [r["quotas"][0] for r in leaves]
    assert len(set(big)) > 1 and all(60 < b < 115 for b in big)


def test_hypergeometric_mean_and_spread(spark):
    sql = mixing._hypergeometric("200L", "60L", "50L", "u")
    draws = [r[0] for r in spark.range(2000).selectExpr("(id + 0.5D) / 2000 AS u").selectExpr(sql).collect()]
    assert np.mean(draws) == pytest.approx(15, abs=0.1)
    assert np.var(draws) == pytest.approx(50 * 0.3 * 0.7 * 150 / 199, rel=0.05)


def test_mix_of_odd_rows(odd, odd_documents, no_documents):
    got = mixing.assign(odd).collect()
    assert len(got) == len(odd_documents)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if not (r["row"]["text"] or "").strip()} == {0}
    assert set(mixing.mix(odd).columns) >= {"rank", "lang", "mix_shard"}
    assert mixing.assign(no_documents).collect() == [] and mixing.mix(no_documents).collect() == []
    clashing = odd.selectExpr("doc_id", "text", "source", "1 AS size", "2 AS target", "3 AS mix_pass", "4 AS block", "5 AS draws", "6 AS id")
    assert sorted((str(r["row"]["doc_id"]), r["taken"]) for r in mixing.assign(clashing).collect()) == sorted((str(r["row"]["doc_id"]), r["taken"]) for r in got)
    mixed = mixing.mix(clashing)
    assert sorted(mixed.columns) == sorted([*clashing.columns, "mix_shard", "mix_words"]) and mixed.filter("size <> 1 or target <> 2 or id <> 6").isEmpty()


def test_running_totals_are_those_of_one_order(spark):
    rows = spark.createDataFrame([(i % 3, i * 7919 % 1000, i % 5) for i in range(1000)], "g int, at int, n long")
    got = {(r["g"], r["at"]): r["before"] for r in mixing.running_total(rows, "g", [F.col("at")], "n", "before", Scratch(spark, "test")).collect()}
    want, total = {}, Counter()
    for g, at, n in sorted(rows.collect()):
        want[g, at] = total[g]
        total[g] += n
    assert got == want


def test_a_cut_block_is_small_however_large_the_source(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('word ', 20) AS text", "if(id % 3 = 0, 'b', 'a') AS source")
    rows = mixing.assign(docs, mixing.MixSettings(block_words=400, shard_words=1000)).collect()
    cut = [r for r in rows if r["taken"] % r["size"]]
    assert len(cut) <= 2  # a document a source
    shards = Counter(d["shard"] for r in rows for d in r["draws"])
    assert len(shards) > 60 and max(shards.values()) < 6 * np.mean(list(shards.values()))
    assert sum(r["taken"] for r in rows) == 120_000


def plain_secrets(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def check_digest(rows, kinds, plain, texts):
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (r, base)
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in base) for k in kinds]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_secrets_are_the_base_ones(spark, sf_dir, documents):
    check_digest(secrets.op7_secret_scan(spark, sf_dir).collect(), secrets.BASE_KINDS, plain_secrets, {i: t for i, t, _ in documents})


@pytest.mark.parametrize(
    "text",
    ["", "TOKEN: abcdefg token=token=abcdef", "ſecret = abcdefgh Kelvin toKen='zzzzzz'", "é password\"  :  'abcdef' passwd=abc passwd=abcdef", "AKIAAKIA" + "A" * 16 + " akia" + "B" * 20, "f" * 23 + " " + "f" * 24 + "é" + "0" * 30, "api_key=1234567 apikey = short api__key=1234567", "secretsecret=abcdefg" * 3],
)
def test_secret_patterns(text):
    assert [x for x in secrets.find(text) if x[0] in secrets.BASE_KINDS] == plain_secrets(text)


def test_checksums_decide():
    body = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1"
    value, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, at = divmod(value, 62)
        tail = secrets.BASE62[at] + tail
    good = f"ghp_{body}{tail}"
    assert secrets.find(f"é {good}.") == [("github", 2, 42)]
    assert secrets.find(f"x {good[:-1]}{'0' if good[-1] != '0' else '1'}.") == []
    assert secrets.redact(f"a {good} b") == "a [SECRET] b"


def test_secrets_of_odd_rows(odd, odd_documents, no_documents):
    got = secrets.find_secrets(odd, out_col="lang").collect()
    assert sum(len(r["lang"]) for r in got) == 3 and len(got) == len(odd_documents)
    assert secrets.find_secrets(no_documents).collect() == []
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(odd).collect()}
    assert redacted[13].count("[SECRET]") == 3 and redacted[1] is None


def plain_personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and tagger.luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda x: (x[1], tagger.KINDS.index(x[0])))


@pytest.mark.parametrize("text", ["", "a@b@c.d@e.f.", "x..y@-.-.z a@b a@b.c@d.e", "1.2.3.4.5.6.7.8 1.2.3.256 0001.02.3.4 1.2.3", f"{LUHN} {LUHN[:-1]}1 {LUHN[:4]}-{LUHN[4:8]} {LUHN[8:]}", "+1 (234) 567-8901 ++12345678901 +1() 2", "é@b.c é.a@b.c"])
def test_personal_patterns(text):
    assert sorted(privacy.base_spans(text), key=lambda x: (x[1], tagger.KINDS.index(x[0]))) == plain_personal(text)


def test_personal_data_holds_the_base_spans(spark, sf_dir, documents):
    check_digest(privacy.op6_personal_data(spark, sf_dir).collect(), tagger.KINDS, plain_personal, {i: t for i, t, _ in documents})


def test_tagger_on_held_out_texts(spark):
    t = tagger.trained(spark)
    rows = tagger.labelled_texts(400, 12345, t.s.window)
    scores, _ = t.forward(np.stack([tagger.char_ids(x) for x, _ in rows]))
    tags = [best for best, _ in t.decode(list(scores.transpose(1, 0, 2)))]
    inner = lambda spans: {x for x in spans if x[1] > 0 and x[2] < t.s.window}
    hits = found = there = 0
    for (_, spans), got in zip(rows, tags):
        a, b = inner(spans), inner(tagger.spans_of(got))
        hits, found, there = hits + len(a & b), found + len(b), there + len(a)
    assert hits / found > 0.9 and hits / there > 0.9


def test_joined_scores_are_decoded_as_by_brute_force():
    t = tagger.Tagger(tagger.TaggerSettings())
    rng = np.random.default_rng(2)
    t.p["trans"] = rng.normal(size=t.p["trans"].shape)
    scores = [rng.normal(size=(n, tagger.N_TAGS)) for n in (1, 4, 0, 3)]
    for most in (4, 1000):
        for u, (tags, outside) in zip(scores, t.decode(scores, most), strict=True):
            paths = list(itertools.product(range(tagger.N_TAGS), repeat=len(u)))
            value = [sum(u[k, x] for k, x in enumerate(p)) + sum(t.p["trans"][a, b] for a, b in zip(p, p[1:])) for p in paths]
            assert tuple(tags) == paths[int(np.argmax(value))]
            weight = np.exp(value) / np.exp(value).sum()
            want = [sum(w for w, p in zip(weight, paths) if p[k] == 0) for k in range(len(u))]
            assert outside == pytest.approx(want, abs=1e-5)


def test_windows_left_out_hold_no_spans(spark, documents):
    t, texts = tagger.trained(spark), [x or "" for _, x, _ in documents[:60]]
    assert privacy.tagged_spans(texts, t) == privacy.tagged_spans(texts, t, everywhere=True)


def test_tagger_adds_what_patterns_miss(spark):
    t = tagger.trained(spark)
    prose = "the ononth ertion of that is and hean thereas " * 4
    text = f"{prose}(555) 123-4567 {prose}{prose}"
    at = text.index("(555)")
    assert privacy.find_all([text], t) == [[("phone", at, at + 14)]]
    assert privacy.find_all([prose, None, "", f"{prose} 2024 {prose} 3.14"], t) == [[], [], [], []]


@pytest.mark.parametrize("times", [1, 10, 100, 500, 3000])
def test_added_spans_do_not_depend_on_the_length_of_a_text(spark, times):
    period = "call (555) 123-4567 or 10.0.0.1 now "
    (spans,) = privacy.find_marked([period * times], tagger.trained(spark))
    added = [x for x in spans if x[3]]
    assert [x[:3] for x in added] == [("phone", 5 + 36 * i, 19 + 36 * i) for i in range(times)]
    assert sum(not x[3] for x in spans) == times  # the addresses


def test_scores_of_long_sequences_are_those_of_short_ones():
    t, rng = tagger.Tagger(tagger.TaggerSettings()), np.random.default_rng(4)
    t.p["trans"] = (rng.normal(size=t.p["trans"].shape) * 2).astype(np.float32)
    one = (rng.normal(size=(50, tagger.N_TAGS)) * 4).astype(np.float32)
    (tags, outside), (long_tags, long_outside) = t.decode([np.concatenate([one] * 3), np.concatenate([one] * 4000)])
    middle = long_outside.reshape(4000, 50)[1:-1]
    assert np.abs(middle - outside[50:100]).max() < 1e-4 and (long_tags.reshape(4000, 50)[1:-1] == tags[50:100]).all()


def test_tagger_on_held_out_long_texts(spark):
    t = tagger.trained(spark)
    rows, text, spans = tagger.labelled_texts(800, 777, t.s.window), "", []
    for piece, found in rows:
        spans += [(k, a + len(text), b + len(text)) for k, a, b in found if a > 0 and b < len(piece)]
        text += piece + "\n"
    assert len(text) > 50_000
    base = privacy.base_spans(text)
    got = privacy.find_marked([text], t)[0]
    missed = [x for x in spans if not any(x[1] < b and a < x[2] for _, a, b in base)]  # what the plain patterns don't touch
    assert len(set(missed) & {x[:3] for x in got if x[3]}) > 0.7 * len(missed)
    assert len([x for x in got if x[3]]) < 1.4 * len(missed)


def test_counts_and_hash_leave_out_added_spans(spark):
    prose = "the ononth ertion of that is and hean thereas " * 4
    text = f"{prose}(555) 123-4567 {prose}ann@b.example {prose}"
    at = text.index("(555)")
    found = privacy.find_personal(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = secrets.digest(found, "personal", tagger.KINDS, lambda s: ~s["added"]).first()
    mail = text.index("ann@")
    assert (row["n_email"], row["n_phone"]) == (1, 0) and row["spans"] == f"phone:{at}:{at + 14},email:{mail}:{mail + 13}"
    check_digest([row], tagger.KINDS, plain_personal, {1: text})


def test_address_parts_of_many_zeros():
    zeros = "0" * 5000
    assert privacy.base_spans(f"{zeros}.2.3.{zeros}7") == [("ip", 0, 10006)]
    many = "0" * 100_000
    assert privacy.base_spans(f"a {many}.1.2.3") == [("ip", 2, 100_008)] and privacy.base_spans(f"a {many}256.1.2.3") == []


def test_gradients_are_right():
    s = tagger.TaggerSettings(hidden=3, embedding=2, window=7)
    t = tagger.Tagger(s)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, tagger.N_CHARS, (2, 7)), rng.integers(0, tagger.N_TAGS, (2, 7))
    _, grads = t.gradients(ids, tags)
    for name, grad in grads.items():
        at = tuple(np.argwhere(np.abs(grad) == np.abs(grad).max())[0])
        old = t.p[name][at]
        t.p[name][at] = old + 1e-4
        up = t.gradients(ids, tags)[0]
        t.p[name][at] = old - 1e-4
        down = t.gradients(ids, tags)[0]
        t.p[name][at] = old
        assert grad[at] == pytest.approx((up - down) / 2e-4, rel=0.02)


def test_personal_data_of_odd_rows(odd, odd_documents, no_documents):
    got = {r["doc_id"]: r["personal"] for r in privacy.find_personal(odd).collect()}
    assert [x["kind"] for x in got[14]] == ["email", "phone", "ip"] and got[1] == []
    assert privacy.find_personal(no_documents).collect() == []


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    rows = packing.op8_best_fit_packing(spark, sf_dir).collect()
    n = check_packing(rows, 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1
    exact = Tokenizer.from_file(packing.PackSettings().tokenizer)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for doc_id, text, _ in documents:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at, want = 0, []
        while at < len(ids):
            size = (len(ids) % 2048 or 2048) if at == 0 else 2048
            want.append((len(want), at, size, zlib.crc32(ids[at : at + size].tobytes())))
            at += size
        assert sorted(pieces[doc_id]) == want


def test_best_fit_is_that_of_single_pieces():
    rng = np.random.default_rng(3)
    for capacity in (10, 64):
        lengths = sorted(rng.integers(1, capacity + 1, 500).tolist(), reverse=True)
        space: list[int] = []
        for x in lengths:
            fits = [i for i, s in enumerate(space) if s >= x]
            if fits:
                space[min(fits, key=lambda i: space[i])] -= x
            else:
                space.append(capacity - x)
        slots = packing.best_fit(dict(Counter(lengths)), capacity)
        used, seen = defaultdict(list), Counter()
        for length, first, n, sequence, each, offset in slots:
            assert first == seen[length]
            seen[length] += n
            for i in range(n):
                used[sequence + i // each].append((offset + i % each * length, length))
        assert seen == Counter(lengths) and len(used) == len(space)
        for parts in used.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= capacity


@pytest.mark.parametrize("text", ["<|endoftext|> x", "漢字 и кириллица", "a b c  \n\n d", "it's they'LL 123 ½ ²", "Ǆ ß ŉ €5 – — …", "\x00\x1f\x7f\x85"])
def test_both_tokenizers_agree(text):
    s = packing.PackSettings()
    assert list(packing.encoder(s.tokenizer, s.ranks)(text)) == packing.encoder(s.tokenizer, None)(text)


@pytest.mark.parametrize("text", [" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "a", "1", "^", "é", "_"])
def test_a_million_equal_characters_are_tokenised(text):
    s = packing.PackSettings()
    fast, exact = packing.encoder(s.tokenizer, s.ranks), packing.encoder(s.tokenizer, None)
    assert list(fast(text * 1_000_000)) == exact(text * 1_000_000)
    assert list(fast(f"x{text * 9000}y")) == exact(f"x{text * 9000}y")


def test_packing_of_odd_rows(odd, odd_documents, no_documents):
    rows = packing.pack(odd, packing.PackSettings(salt_rows=2), with_ids=True).collect()
    check_packing(rows, 2048)
    assert sum(r["piece"] == 0 for r in rows) == len(odd_documents)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack(no_documents).collect() == []


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_quality_features_and_rules(spark, sf_dir, documents):
    texts = {i: t for i, t, _ in documents}
    for r in quality.op10_quality_rules(spark, sf_dir).collect():
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == plain_quality(texts[r["doc_id"]])
        failed = got[0] < 50 or 100 * got[4] > 50 * got[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_verdicts_on_labels(spark):
    """On documents that were not labelled for the fit, most good ones stay and most bad ones go."""
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    held = quality.judge(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), model, out_col="q").filter("not q.base_failed").selectExpr("quality", "q.kept").collect()
    good, bad = ([r["kept"] for r in held if r["quality"] == k] for k in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.35


def test_quality_of_odd_rows(spark, odd, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(odd, quality.fit(odd, none)).collect()
    assert len(got) == len(odd_documents)
    for r in got:
        assert tuple(r["quality"])[:5] == plain_quality(r["text"])
        assert r["quality"]["kept"] == (not r["quality"]["base_failed"])
    assert quality.judge(no_documents, quality.fit(no_documents, none)).collect() == []
