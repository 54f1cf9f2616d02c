"""Corpus operators against brute force, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import decontamination, license_scan, ngram_join, packing, quality_classifier, quality_rules, repeats, secret_scan, substring_dedup, suffix_dedup, token_files
from glimmer.llm.shared import components, materialize, new_path
from glimmer.llm.tokens import encoder, tokenizer_path

WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tur", "san") for b in ("na", "ro", "vi", "ple", "sh", "ing")]
SCHEMA = "doc_id long, text string, n long, h string, token string, start int, own long, grade int"


def corpus():
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    passage, base = text(60), text(80)
    near = base.split()
    near[40] = "changed"
    docs = [text(120) for _ in range(6)]
    docs += [base, base, " ".join(near), base.upper(), text(30) + " " + passage + " " + text(30), text(10) + "\n" + passage, passage]
    docs += [None, "", " \t\n", "one", "one two three", "ONE  two\nthree", "la " * 300, "so it so it " * 80, text(9000), "é ü ß " * 50, "tab\there  x y <|endoftext|> z"]
    docs += ['password = "' + "a1B2c3D4e5" + '"', "AKIA" + "ABCDEFGH12345678", "f" * 20 + "0123456789ab" * 2, "line\n" * 40]
    return [(i, t) for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x", "y", 2, 3, 4) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(12)] + [(200, 200 + i) for i in range(1, 30)]
    want = {}
    for a, b in edges:
        if a != b:
            want.setdefault(a, {a})
            want.setdefault(b, {b})
            joined = want[a] | want[b]
            for x in joined:
                want[x] = joined
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: min(v) for k, v in want.items()}


def sets(text):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    w = (text or "").encode().translate(lower).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_ngram_join(docs, empty):
    own = {i: sets(t) for i, t in corpus()}
    parent = {i: i for i in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in own:
        for b in own:
            both = len(own[a] & own[b])
            if a < b and both and 100 * both >= 80 * len(own[a] | own[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = by_id(ngram_join.similar_components(docs))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == {i: (len(own[i]), root(i)) for i in own}
    assert ngram_join.similar_components(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in own if root(i) == i}


def test_ngram_join_repeated_and_null_ids(spark):
    t = "a b c d e f g h i j k l"
    d = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t), (3, "z")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.similar_components(d).collect())
    assert got == {(1, 1): 2, (None, None): 1, (2, 1): 1, (3, 3): 1}


@pytest.mark.parametrize("seed", range(3))
def test_ngram_join_families(spark, seed):
    """Many near copies, some chains, around the similarity limit."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(4):
        base = list(rng.choice(WORDS, 70))
        for _ in range(25):
            own = list(base)
            for at in rng.integers(0, 70, rng.integers(0, 5)):
                own[at] = str(rng.choice(WORDS)) + str(rng.integers(9))
            rows.append((len(rows), " ".join(own)))
    own = {i: sets(t) for i, t in rows}
    label = dict(enumerate(range(len(rows))))
    changed = True
    links = [(a, b) for a in own for b in own if a < b and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = by_id(ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: r["component_id"] for k, r in got.items()} == label


def test_ngram_join_links_inside_a_group(spark):
    """Three texts of one size and one prefix: the least doc_id links with neither of the others, which link with each other."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    trials = []
    for i in range(3000):
        w = [f"w{i}x{k}" for k in rng.permutation(50)]
        trials.append([" ".join(x) for x in (w[:6] + w[20:27], w[:13], w[:12] + w[30:31])])
    found = [own for part in ngram_join.slices(pa.array([t for x in trials for t in x])) for own in ngram_join.shingle_sets(part)]
    firsts = [{tuple(own[: ngram_join.prefix_length(9)].tolist()) for own in found[3 * i : 3 * i + 3]} for i in range(len(trials))]
    three = trials[next(i for i, x in enumerate(firsts) if len(x) == 1)]
    h, m1, m2 = map(sets, three)
    assert 100 * len(m1 & m2) >= 80 * len(m1 | m2) and 100 * len(h & (m1 | m2)) < 80 * len(m1)
    docs = spark.createDataFrame(list(enumerate(three)), "doc_id long, text string")
    assert {k: r["component_id"] for k, r in by_id(ngram_join.similar_components(docs)).items()} == {0: 0, 1: 1, 2: 1}
    assert {r["doc_id"] for r in ngram_join.keep_one(docs).collect()} == {0, 1}


def test_quality_statistics(docs, empty):
    got = by_id(quality_rules.statistics(docs, ["doc_id"]))
    for i, t in corpus():
        w = (t or "").encode().split()
        count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
    assert quality_rules.statistics(empty, ["doc_id"]).count() == 0


def test_decision_list_learns_and_abstains(spark):
    rng = np.random.default_rng(3)
    cells = []
    for i in range(300):
        bad = i % 3 == 0
        bins = (int(rng.integers(2, 6)), 3, 5 if bad else int(rng.integers(0, 2)), 0, 0, 5)
        cells.append((bins, i % 2 == 0, bad, 4))
    limits = {name: [float(x) for x in range(1, 7)] for name in quality_rules.ratios()}
    rules, ended = quality_rules.learn(cells, limits)
    assert rules and ended == "nothing left" and all(c[0] == "symbols" and c[1] for r in rules for c in r)
    noise = [(tuple(int(x) for x in rng.integers(0, 4, 6)), bool(rng.integers(2)), bool(rng.integers(2)), 1) for _ in range(200)]
    assert quality_rules.learn(noise, limits)[0] == [] and quality_rules.learn([], limits) == ([], "nothing left")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    d = quality_rules.judge(spark.createDataFrame([(1, "a b"), (2, " ".join(WORDS))], "doc_id long, text string"), labels)
    assert {r["doc_id"]: r["kept"] for r in d.collect()} == {1: False, 2: True}


def test_token_files(spark, docs, empty):
    manifest = token_files.write_token_files(docs, new_path(spark, "t"), tokenizer_path(), 2)
    got = by_id(token_files.read_token_files(manifest))
    own, start = encoder(tokenizer_path()), 0
    for i, t in corpus():
        want = own.encode(t or "") + [2]
        r = got[i]
        assert (r["start"], r["n_tokens"], list(np.frombuffer(r["ids"], "<u4"))) == (start, len(want), want), i
        start += len(want)
    path = manifest.orderBy("shard").first()["path"]
    file = token_files.TokenFile(path)
    for i in range(file.n_docs):
        assert list(file.ids(i)) == own.encode(dict(corpus())[file.doc_id(i)] or "") + [2]
    assert token_files.read_token_files(token_files.write_token_files(empty, new_path(spark, "t"), tokenizer_path(), 2)).count() == 0


def test_token_file_of_many_documents(spark):
    """Blocks of bounds over more documents than a block has, rows without doc_id first."""
    rows = [(None, f"w{i}") for i in range(300)] + [(i * 3, f"some w{i} words") for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = token_files.read_token_files(token_files.write_token_files(d, new_path(spark, "t"), tokenizer_path(), 2)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    own = encoder(tokenizer_path())
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((i, np.array([*own.encode(t), 2], "<u4").tobytes()) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [i for i, _ in rows]


def test_elias_fano():
    rng = np.random.default_rng(5)
    for values in ([], [0], [7] * 600, np.sort(rng.integers(0, 10**7, 3000)), np.arange(1000), [0, 2**40]):
        values = np.array(values, np.int64)
        e = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(values).to_bytes())
        assert (e.values() == values).all() and all((e.block(i) == values[i : i + token_files.SAMPLE]).all() for i in range(0, len(values), token_files.SAMPLE)) and [e.select(i) for i in range(len(values))] == values.tolist()
    big = np.sort(rng.integers(0, 2**31, 20_000))
    assert len(token_files.EliasFano.encode(big).to_bytes()) * 8 / len(big) < 2.7 + np.log2(2**31 / len(big))


def test_packing(docs, empty):
    own = {i: encoder(tokenizer_path()).encode(t or "") + [0] for i, t in corpus()}
    pieces = packing.pack(docs, tokenizer_path(), 0).collect()
    held, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert list(np.frombuffer(p["ids"], "<u4")) == own[p["doc_id"]][p["start"] : p["start"] + p["length"]] and p["doc_tokens"] == len(own[p["doc_id"]])
        held[p["doc_id"]].append((p["start"], p["length"]))
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans, total in [(sorted(held[i]), len(own[i])) for i in own] + [(sorted(w), sum(n for _, n in w)) for w in windows.values()]:
        at = 0
        for a, n in spans:
            assert a == at
            at += n
        assert at == total
    assert max(sum(n for _, n in w) for w in windows.values()) <= 1024
    assert packing.pack(empty, tokenizer_path(), 0).count() == 0


def test_repeated_and_null_ids(spark):
    """Rows without or with equal doc_ids are packed and written row by row."""
    rows = [(1, "one two"), (1, "three"), (None, "four"), (None, None), (2, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    own = encoder(tokenizer_path())
    got = Counter((p["doc_id"], bytes(p["ids"])) for p in packing.pack(d, tokenizer_path(), 0).collect())
    assert got == Counter((i, np.array([*own.encode(t or ""), 0], "<u4").tobytes()) for i, t in rows)
    read = token_files.read_token_files(token_files.write_token_files(d, new_path(spark, "t"), tokenizer_path(), 2)).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in read) == Counter((i, np.array([*own.encode(t or ""), 2], "<u4").tobytes()) for i, t in rows)
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in read)
    assert [s for s, _, _ in starts] == np.concatenate([[0], np.cumsum([n for _, n, _ in starts])[:-1]]).tolist()
    assert [i for _, _, i in starts] == [None, None, 1, 1, 2]


def test_differencing_balances():
    sizes = np.random.default_rng(6).integers(100, 257, 700)
    sets_ = packing.differencing(sizes, 120)
    assert sorted(x for s in sets_ for x in s) == list(range(700))
    sums = [sizes[s].sum() for s in sets_]
    assert max(sums) - min(sums) <= 100  # the least item
    assert all(sizes[s].sum() <= 1024 for s in packing.deal(sizes, 1024))


def patterns(text):
    """kind:start:end of the three patterns, found character by character."""
    value = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
    fold = "".join(c.lower() if c.isascii() else c for c in text)

    def run(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    def assign(at):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if fold.startswith(w, at)), None)
        if word is None:
            return None
        k = at + len(word)
        k += text[k : k + 1] in ("'", '"') and k < len(text)
        k = run(k, " ")
        if text[k : k + 1] not in (":", "="):
            return None
        k = run(k + 1, " ")
        k += text[k : k + 1] in ("'", '"') and k < len(text)
        return (k, run(k, value)) if run(k, value) > k else None

    out, at = [], 0
    while at < len(text):
        found = assign(at)
        if found and found[1] - found[0] >= 8:
            out.append((at, 0, found[1]))
        at = found[1] if found else at + 1
    for kind, head, allowed, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), (2, "", set("0123456789abcdef"), 32)):
        at = 0
        while at < len(text):
            end = run(at + len(head), allowed) if text.startswith(head, at) else at
            if end > at + len(head):
                if end - at >= least:
                    out.append((at, kind, end))
                at = end
            else:
                at += 1
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_query(spark, tmp_path):
    """The query's columns on texts with all patterns, near misses, planted random strings, nulls and repeated rows."""
    import base64
    import random

    rng = random.Random(2)
    keys = [base64.b64encode(rng.randbytes(36)).decode() for _ in range(20)] + ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=40)) for _ in range(20)] + ["".join(rng.choices("0123456789ABCDEF", k=64)) for _ in range(20)]
    texts = [f"some words {k} and more é words" for k in keys]
    texts += ["path/to/the/configuration/file_name_here", "internationalization_of_everything", "AbstractSingletonProxyFactoryBean " * 3, "-" * 70, "=" * 40, "_" * 30 + "/" * 30]
    texts += ["Password: 'abc.def-123', token=short, api_key = \"x\" apikey:AAAAAAAAA", "secret secret=secret=abcdefgh12", "AKIA AKIAAKIA12 AKIAABCDEFGHIJKL xAKIA" + "Z" * 20, "deadbeef" * 4 + "g" + "deadbeef" * 3, "ſecret=abcdefghi toKen=abcdefghi token\n=abcdefgh"]
    texts += ["", None, texts[0], "token=" + "a" * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = secret_scan.op5_secret_scan(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    random_found = 0
    for r in got:
        want = patterns(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x.startswith(k) for x in want.split(",")) for k in ("assign", "access", "hex")]
        spans = [x for x in r["spans"].split(",") if x]
        assert [x for x in spans if not x.startswith("random")] == [x for x in want.split(",") if x]
        own = [x for x in spans if x.startswith("random")]
        if r["doc_id"] < len(keys):
            _, a, b = (own or ["random:0:0"])[0].split(":")
            random_found += (texts[r["doc_id"]][int(a) : int(b)] == keys[r["doc_id"]]) / (1 + (r["doc_id"] == 0))
        elif texts[r["doc_id"]] != texts[0]:
            assert not own
    assert random_found >= 57


def test_secret_scan(docs, empty):
    found = secret_scan.find_spans(docs)
    d = by_id(secret_scan.secrets(found, secret_scan.accepted_bins(found)).withColumn("base_text", secret_scan.digest("base")))
    for i, t in corpus():
        assert d[i]["base_text"] == patterns(t or "")
    assert sum("assign" in r["base_text"] for r in d.values()) == 1 and sum("access" in r["base_text"] for r in d.values()) == 1 and sum("hex" in r["base_text"] for r in d.values()) == 1
    out = by_id(secret_scan.redact(docs))
    assert "a1B2c3D4e5" not in out[24]["text"] and out[0]["text"] == corpus()[0][1] and out[13]["text"] is None
    assert secret_scan.redact(docs).columns == docs.columns and secret_scan.redact(empty).count() == 0
    none = secret_scan.find_spans(empty)
    assert secret_scan.secrets(none, secret_scan.accepted_bins(none)).count() == 0


def test_randomness_battery():
    import base64
    import random

    rng = random.Random(8)
    keys = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(200)]
    plain = ["".join(rng.choice(WORDS) for _ in range(8)) for _ in range(200)]
    flagged = lambda xs: sum(u >= secret_scan.BATTERY and p < 1e-3 for u, p in map(secret_scan.battery, xs)) / len(xs)
    assert flagged(keys) > 0.9 and flagged(plain) < 0.02


def test_secret_candidates_split():
    """NAME=value, two values in a row, and what is left beside a pattern's match are tested by themselves."""
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ83kLm2Tv"
    spans = lambda t: [t[a:b] for a, _, b, _, _ in secret_scan.other_spans(t, secret_scan.base_spans(t))]
    assert spans(f"AWS_ACCESS_KEY_VALUE=x sig={key}") == ["AWS_ACCESS_KEY_VALUE", key] and spans(f"?sig={key}==&x") == [f"{key}=="]
    assert spans(f"{key}={key}=") == [key, f"{key}="]
    assert spans("0123456789abcdef" * 2 + "/" + key) == ["/" + key]
    found = secret_scan.other_spans(f"sig={key}", [])[0]
    assert found[4] and found[3] % secret_scan.BINS >= 30


def test_randomness_battery_small_alphabets():
    import random

    rng = random.Random(5)
    strings = lambda alphabet, n: ["".join(rng.choices(alphabet, k=n)) for _ in range(300)]
    flagged = lambda xs, p=1e-3: sum(u >= secret_scan.BATTERY and q < p for u, q in map(secret_scan.battery, xs)) / len(xs)
    upper, lower, digits = "0123456789ABCDEF", "0123456789abcdef", "0123456789"
    assert flagged(strings(upper, 32)) > 0.8 and flagged(strings(upper, 64), 1e-6) > 0.9
    assert flagged(strings(lower, 28)) > 0.7 and flagged(strings(lower, 20), 1e-2) > 0.5
    assert flagged(strings(digits, 64), 1e-2) > 0.9 and flagged(strings(digits, 128)) > 0.9  # ten characters alone tell little
    base32, base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", secret_scan.ALPHABETS[5]
    assert flagged(strings(base32, 28)) > 0.9 and flagged(strings(base62, 40)) > 0.9 and flagged(strings(base62, 300), 1e-6) > 0.9
    words = ["dead", "beef", "cafe", "face", "decade", "added", "facade", "2024", "1000", "200", "19990", "12"]
    text = ["".join(rng.choice(words) for _ in range(8)) for _ in range(300)]
    dates = ["".join(f"20{rng.randrange(10, 25)}{rng.randrange(1, 13):02}{rng.randrange(1, 29):02}" for _ in range(4)) for _ in range(300)]
    assert flagged(text) < 0.02 and flagged(dates) < 0.02


def test_decontamination(spark, docs, empty):
    items = [(0, " ".join(corpus()[12][1].split()[:30])), (1, corpus()[12][1] + " extra words that do not occur anywhere at all in it"), (2, "one two"), (3, None), (4, "never seen words in any of the texts here"), (None, "x")]
    items = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontamination.contaminated(docs, items).collect()}
    want = {}
    for i, t in corpus():
        for j, own in ((r["item_id"], sets((r["text"] or "").lower())) for r in items.collect() if r["item_id"] is not None and r["text"]):
            own = {x for x in own if len(x) == 5}
            shared = len(own & sets((t or "").lower()))
            if own and 100 * shared >= 80 * len(own):
                want[i, j] = (shared, len(own))
    want_short = {(i, 2): (1, 1) for i, t in corpus() if b" one two " in b" " + b" ".join((t or "").lower().encode().split()) + b" "}
    assert got == want | want_short and len(want) >= 4 and want_short
    again = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items, short=False).collect()}
    assert again == set(want)
    assert decontamination.contaminated(empty, items).count() == 0 and decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_license_scan(spark, empty):
    mit = license_scan.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 A. Person\n\n" + mit), (2, mit.upper().replace(",", "")), (3, mit + " and more"), (4, "text\nReleased under the MIT Licence\nmore"), (5, None), (6, ""), (1, "Copyright (c) 2020 A. Person\n\n" + mit), (7, mit + " word" * 50_000)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, digest string, license string, notices string")
    got = license_scan.scan(docs, license_scan.known_digests(spark))
    assert got.columns == ["doc_id", "digest", "license", "notices"] and got.count() == 8
    got = by_id(got)
    assert [got[i]["license"] for i in range(1, 8)] == ["MIT", "MIT", None, None, None, None, None] and got[4]["notices"] == ["MIT"]
    assert license_scan.scan(empty, license_scan.known_digests(spark)).count() == 0
    none = license_scan.known_digests(spark).limit(0)
    assert all(r["license"] is None and r["notices"] == [] for r in license_scan.scan(docs, none).collect())


def canonical(text):
    """The canonical form, word by word."""
    lines = [x for x in text.split("\n") if not re.match(license_scan.COPYRIGHT_LINE.replace("\\p{L}\\p{N}", "a-zA-Z0-9"), x)]
    words = re.sub(r"[\W_]+", " ", "\n".join(lines).lower()).split()
    single = {a: b.split() for a, b in license_scan.SPELLINGS if " " not in a}
    words = [y for x in words for y in single.get(x, [x])]
    out = []
    for w in words:
        if w == "cent" and out[-1:] == ["per"]:
            out[-1] = "percent"
        elif w == "owner" and out[-1:] == ["copyright"]:
            out.append("holder")
        else:
            out.append(w)
    return " ".join(out)


def test_license_canonical_form(spark):
    texts = [x for _, x in license_scan.KNOWN] + ["licence licence LICENCES, the licence", "per cent per cent, Copyright owner copyright owner's", "per per cent cent", "noncommercial, non-commercial https://x", "a\nCopyright (C) 2001 X\n(c) 2003 y\n(c) you may\ncopyright license to\nAll rights reserved.\nb", "© 2020", " "]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", license_scan.canonical(F.col("t")).alias("c"))
    assert {r["i"]: r["c"] for r in d.collect()} == {i: canonical(t) for i, t in enumerate(texts)}


def test_license_whole_texts(spark):
    """Digests of entire licenses, from the texts that this system ships; rewrapped, with British spelling and another holder."""
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {k: (folder / f).read_text() for k, f in names.items() if (folder / f).exists()}
    if not texts:
        pytest.skip("no license texts here")
    rows = []
    for k, t in texts.items():
        british = re.sub(r"\blicense(s|d)?\b", r"licence\1", t).replace("acknowledgment", "acknowledgement")
        rows += [(f"{k} 0", t), (f"{k} 1", british + "\nCopyright (c) 2024 Someone Else\n"), (f"{k} 2", "    " + t.upper().replace(".", " . ")), (f"{k} -", t[:-200])]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string"), license_scan.known_digests(spark)).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {f"{k} {i}": k if i != "-" else None for k in texts for i in "012-"}


def test_quality_classifier(spark, empty):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(600):
        grade = i % 3
        words = list(rng.choice(WORDS, 60)) + (["vile", "awful"][: 2] if grade == 0 else ["dull"] if grade == 1 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i < 450:
            labels.append((i, grade))
    rows += [(600, None), (601, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    w, t = quality_classifier.fit(d, spark.createDataFrame(labels, "doc_id long, grade int"), 3)
    got = by_id(quality_classifier.score(d, w, t))
    assert (np.diff(t) > 0).all() and len(got) == 602
    right = sum((got[i]["tails"][0] >= 0.5) + (got[i]["tails"][1] >= 0.5) == i % 3 for i in range(450, 600))
    assert right >= 135  # held-out
    assert all(r["tails"][0] >= r["tails"][1] for r in got.values())
    w, t = quality_classifier.fit(empty.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert not w.any()


def removed(texts, width, unit, keep_first):
    seen = Counter()
    for _, u in texts:
        seen.update(tuple(u[k : k + width]) for k in range(len(u) - width + 1))
    out, before = {}, set()
    for i, u in texts:
        gone = np.zeros(len(u), bool)
        for k in range(len(u) - width + 1):
            w = tuple(u[k : k + width])
            if (w in before) if keep_first else seen[w] > 1:
                gone[k : k + width] = True
            before.add(w)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(u) else 0
        out[i] = (len(u), int(gone.sum()), spans, hashlib.sha256(unit([x for x, g in zip(u, gone, strict=True) if not g])).hexdigest())
    return out


def test_substring_dedup(docs, empty):
    want = removed([(i, (t or "").encode().split()) for i, t in corpus()], 35, b" ".join, False)
    got = by_id(substring_dedup.remove_repeats(docs))
    assert {i: (r["n_words"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup(docs, empty):
    want = removed([(i, (t or "").encode()) for i, t in corpus()], 100, bytes, True)
    got = by_id(suffix_dedup.remove_repeats(docs))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_crowded_anchors_are_split(spark, monkeypatch, module):
    """A passage in many texts with other words around it each time, some of them twice: crowded anchors are halved."""
    rng = np.random.default_rng(12)
    passage, side = list(rng.choice(WORDS, 70)), [f"{w}{i}" for w in WORDS for i in range(5)]
    texts = [" ".join([*rng.choice(side, rng.integers(2, 30)), *passage[int(rng.integers(0, 4)) :], *rng.choice(side, rng.integers(2, 30))]) for _ in range(60)]
    texts += texts[:3] + [t + " tail" for t in texts[5:25]] + ["head " + t for t in texts[20:40]]
    monkeypatch.setattr(repeats, "CROWD", 6)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = module is substring_dedup
    want = removed([(i, t.encode().split() if words else t.encode()) for i, t in enumerate(texts)], 35 if words else 100, b" ".join if words else bytes, not words)
    assert {i: (r[1], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in by_id(module.remove_repeats(d)).items()} == want


@pytest.mark.parametrize("seed", range(4))
def test_symbols_of_equal_windows(seed):
    """Windows of equal words have the anchor at the same place under the same name, whatever surrounds them."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    few = list(rng.choice(WORDS, 4 + 10 * seed))
    window = [w for w in rng.choice(few, 20) for _ in range(rng.integers(1, 5))][:35]
    window += list(rng.choice(few, 35 - len(window)))
    texts = [" ".join([*rng.choice(few, rng.integers(0, 50)), *window, *rng.choice(few, rng.integers(0, 50))]) for _ in range(60)]
    units, seen = substring_dedup.WordUnits(), set()
    for part in repeats.slices(pa.array(texts)):
        r = units.runs(part)
        for i, t in enumerate(texts):
            own = t.split()
            at = [k for k in range(len(own) - 34) if own[k : k + 35] == window]
            for k in at:
                j = np.flatnonzero((r.row == i) & (r.start <= k) & (k < r.start + r.count))[0]
                seen.add((int(r.start[j] + r.ahead[j] - k), int(r.name[j])))
    assert len(seen) == 1


def test_repeated_rows_count_once(spark):
    t = " ".join(np.random.default_rng(1).choice(WORDS, 200))
    d = spark.createDataFrame([(1, t), (1, t), (2, "short"), (None, "x")], "doc_id long, text string")
    for module in (substring_dedup, suffix_dedup):
        got = sorted((str(r["doc_id"]), r["n_removed"]) for r in module.remove_repeats(d).collect())
        assert got == [("1", 0), ("2", 0), ("None", 0)]


@pytest.mark.parametrize("seed", range(30))
def test_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(97, 99, rng.integers(1, 30)).astype(np.int32) for _ in range(rng.integers(1, 8))]
    text = np.concatenate([np.append(p, 256 + i) for i, p in enumerate(parts)])
    order, own = suffix_dedup.suffix_order(text), text.tolist()
    assert order.tolist() == sorted(range(len(own)), key=lambda i: own[i:])
    lcp = suffix_dedup.common_prefixes(text, order, 6, 256)
    for k in range(1, len(own)):
        a, b = own[order[k - 1] :], own[order[k] :]
        same = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(same, 6)


def test_crc_of_packed_ids(docs):
    d = packing.pack(docs.where("doc_id = 0"), tokenizer_path(), 0).select("ids", F.crc32("ids").alias("c")).first()
    assert zlib.crc32(d["ids"]) == d["c"]


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text[:n], text[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_patterned_words_stay_apart(spark, n):
    """Words whose polynomial hashes modulo a power of two are equal, and near-equal long words."""
    x, y = thue_morse(n)
    rng = np.random.default_rng(2)
    block = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 600))
    before, after = " ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(20))
    texts = [x, y, f"{before} {x} {after}", f"{before} {y} {after}", block, block[:300] + "!" + block[301:], f" {block}", f"q {block[:-1]} {block}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r["component_id"] for r in ngram_join.similar_components(frame).collect()} == set(range(len(texts))) - {6}  # 6 has the words of 4
    assert all(r["n_removed"] == 0 for r in substring_dedup.remove_repeats(frame).collect())
    plain = encoder(tokenizer_path()).tokenizer
    ids = {i: plain.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    pieces = {}
    for r in packing.pack(frame, tokenizer_path(), end_id=0).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert {i: b"".join(p for _, p in sorted(v)) for i, v in pieces.items()} == {i: np.array(v + [0], "<u4").tobytes() for i, v in ids.items()}


def test_ranges_hash_by_content():
    from glimmer.llm import words

    values = np.random.default_rng(1).integers(0, 2**64 - 1, 300, dtype=np.uint64)
    twice = words.Ranges(np.concatenate([values, values[:1], values]))
    assert (twice.hashes(np.arange(100), np.arange(100) + 90) == twice.hashes(np.arange(100) + 301, np.arange(100) + 391)).all()
    x, y = (np.frombuffer(t.encode(), np.uint8) for t in thue_morse(2048))
    own = words.Ranges(np.concatenate([x, y])).hashes(np.array([0, 2048]), np.array([2048, 4096]))
    assert own[0] != own[1]


def test_quality_verdicts(spark, empty):
    """kept and base_failed of the query's operator against a plain reading of its rules and their expression."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(WORDS, int(rng.integers(3, 60))))
        bad = i % 4 == 0
        rows.append((i, " ".join(words + ["#" * 8] * (bad * max(1, len(words) // 5)))))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, "so it " * 30), (1001, None), (1001, None), (1002, ""), (1003, " ".join(rng.choice(WORDS, 30_000)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_rules.judge(d, known).collect()
    assert len(got) == len(rows)
    rules, ended = quality_rules.learned(materialize(quality_rules.statistics(d, ["doc_id"]), "test-statistics"), known)
    assert rules and {r["ended"] for r in got} == {ended}
    for r in got:
        w, p = r["n_words"], lambda a, b: a / b if b else 0.0
        ratio = {"words": w, "word_length": p(r["word_chars"], w), "symbols": p(r["n_symbols"], r["word_chars"]), "dup_lines": p(r["n_dup_lines"], r["n_lines"]), "repeats": p(r["n_repeat_words"], w), "distinct": p(r["n_distinct"], w)}
        failed = w < 10 or 100 * r["n_repeat_words"] > 20 * w
        first = next((i for i, rule in enumerate(rules, 1) if all((ratio[n] >= t) == up for n, up, t in rule)), None)
        assert (r["base_failed"], r["rule"], r["kept"]) == (failed, first, not failed and first is None)
    right = sum(r["kept"] == (r["doc_id"] % 4 != 0) for r in got if r["doc_id"] < 400 and not r["base_failed"])
    assert right >= 0.97 * sum(not r["base_failed"] for r in got if r["doc_id"] < 400)
    assert quality_rules.judge(empty.select("doc_id", "text"), known).count() == 0


def test_long_and_repeated_items(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    more = spark.createDataFrame([(7, long), (7, long), (8, corpus()[12][1])], "item_id long, text string")
    found = decontamination.contaminated(spark.createDataFrame([(1, long + " tail"), (1, long), (2, "a b")], "doc_id long, text string"), more)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7, 29_996, 29_996)]


def test_ordinal_likelihood_and_scores(spark):
    """The fit reaches a likelihood that small moves do not raise; scores are those of a plain reading of the model."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(WORDS[:12], 8)) for _ in range(300)]
    grades = np.array([min(2, sum(w in t.split() for w in (WORDS[0], WORDS[5]))) for t in texts])
    rows = [part[2][a:b] for part in quality_classifier.features(pa.array(texts)) for a, b in zip(part[1][:-1], part[1][1:], strict=True)]
    seen, w, t = quality_classifier.fit_ordinal(rows, grades, 3)
    place = {b: i for i, b in enumerate(seen.tolist())}
    x = np.zeros((len(rows), len(seen)))
    for i, r in enumerate(rows):
        x[i, [place[b] for b in r.tolist()]] = 1

    def likelihood(w, t):
        q = np.concatenate([np.ones((len(x), 1)), 1 / (1 + np.exp(-(x @ w)[:, None] + t)), np.zeros((len(x), 1))], axis=1)
        at = np.arange(len(x))
        return np.log(np.maximum(q[at, grades] - q[at, grades + 1], 1e-12)).mean()

    base, flat = likelihood(w, t), likelihood(np.zeros(len(w)), t)
    assert base > flat / 3  # logs: much closer to zero
    for _ in range(50):
        assert likelihood(w + rng.normal(0, 0.05, len(w)), t + np.sort(rng.normal(0, 0.05, 2))) < base + 0.02
    weights = np.zeros(quality_classifier.BUCKETS, np.float32)
    weights[seen] = w
    d = spark.createDataFrame([(i, s) for i, s in enumerate(texts[:40])] + [(0, texts[0]), (99, None), (98, " ".join(WORDS * 5000))], "doc_id long, text string")
    got = quality_classifier.score(d, weights, t).collect()
    assert len(got) == 43
    for r in got:
        if r["doc_id"] < 40:
            tails = 1 / (1 + np.exp(-x[r["doc_id"]] @ w.astype(float) + t))
            assert np.allclose(r["tails"], tails, atol=1e-5) and abs(r["expected_grade"] - tails.sum()) < 1e-5
    assert quality_classifier.score(d.limit(0), weights, t).count() == 0


def test_remembered_chunks_are_compared(monkeypatch):
    """Ids stay right where all contents share one hash, and in a memory of any size."""
    import pyarrow as pa

    from glimmer.llm import tokens

    texts = ["one two three two one", "three  two\none", "x" * 40 + " " + "x" * 39 + "y", "", "one"] * 3
    for memory, same in ((10**6, False), (3, False), (10**6, True)):
        if same:
            monkeypatch.setattr(tokens, "mix", lambda x: np.zeros_like(x))
        own = tokens.Encoder(tokenizer_path(), memory)
        for _ in range(2):
            got = [r.flat[a:b].tolist() for part in tokens.slices(pa.array(texts), 64) for r in [own.slice_ids(part)] for a, b in zip(r.bounds[:-1], r.bounds[1:], strict=True)]
            assert got == [own.encode(t) for t in texts]
