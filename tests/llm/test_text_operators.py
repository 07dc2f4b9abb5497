"""Secrets, near-duplicates, decontamination, media and the classifiers against brute force, round trips and held-out rows."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeingraph.llm import decontaminate, jpeg, langid, media, neardup, probminhash, quality, secrets, toxicity
from skeingraph.llm.textbuf import Words, mix, shingles
from skeingraph.session import fresh_path
from skeingraph.sources.tables import table

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", None, "own") for k, t in enumerate(texts)], DOCS)


# secrets


def brute_base(text):
    text, out = text or "", []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [x[2] for x in sorted(out)]


SECRETS = ["PassWord = 'abcdef123'", "secret: token :abcdefgh", "paſſword=abcdefgh toKen=abcdefgh", "𝄞 AKIA" + "A" * 16 + " AKIAshort AKIAAKIA" + "B" * 14, "x" + "0a" * 12 + "g" + "0a" * 11, "password=" + "ab" * 14, None, "", "api_key=12345 apikey=123456", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "https://u:p4ss@h/x", "a" * 50_000 + " token=zzzzzz"]


def test_spans_against_brute_force(spark):
    docs = docs_of(spark, SECRETS + SECRETS[:3])
    ledger = secrets.Ledger(spark, fresh_path(spark, "ledger"))
    got = {r["doc_id"]: r for r in secrets.digests(secrets.scan_paths(docs, ledger)).collect()}
    for k, t in enumerate(SECRETS + SECRETS[:3]):
        base = brute_base(t)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert set(base) <= set(got[k]["spans"].split(",")) | ({""} if not base else set())
        assert got[k]["n_assign"] == sum(b.startswith("assign") for b in base)
    assert "pem:0:" in got[9]["spans"] and "userinfo:" in got[10]["spans"]


def test_ledger_scans_only_what_is_new(spark):
    path = fresh_path(spark, "ledger")
    ledger = secrets.Ledger(spark, path)
    first = docs_of(spark, SECRETS)
    secrets.scan_paths(first, ledger)
    n = ledger.scanned().count()
    assert n == len({t or "" for t in SECRETS})
    more = docs_of(spark, [*SECRETS, "secret=brandnew1"])
    again = secrets.digests(secrets.scan_paths(more, ledger)).collect()
    assert ledger.scanned().count() == n + 1 and len(again) == len(SECRETS) + 1
    assert [r["n_assign"] for r in again if r["doc_id"] == len(SECRETS)] == [1]
    other = secrets.Ledger(spark, path, "rules-2")
    assert other.scanned().count() == 0
    assert secrets.scan_paths(first.limit(0), ledger).count() == 0


def test_redaction(spark):
    text = "k: token=abcdef99 end é " + "0f" * 12
    assert secrets.cleaned(text, secrets.spans(text)) == "k: <assign> end é <hex>"
    assert secrets.cleaned("abcdefgh", [("x", 1, 4), ("y", 3, 6), ("z", 6, 7)]) == "a<x><z>h"
    docs = spark.createDataFrame([(1, text, "own", len(text)), (2, None, "own", None), (3, "clean", "own", 77)], "doc_id long, text string, _spans string, n_chars int")
    got = secrets.redacted(docs, secrets.Ledger(spark, fresh_path(spark, "ledger")))
    assert got.schema == docs.schema
    assert sorted(map(tuple, got.collect())) == [(1, "k: <assign> end é <hex>", "own", 23), (2, None, "own", None), (3, "clean", "own", 77)]


def test_tokens_in_linear_time():
    r, pattern = random.Random(3), re.compile(secrets.EXTRA[1][1])
    for _ in range(20_000):
        text = "".join(r.choice(["eyJ", ".", "a", "-", " ", "eyJa.", "eyJ.", "_"]) for _ in range(r.randrange(1, 16)))
        assert [m.span() for m in pattern.finditer(text)] == list(secrets._jwts(text))
    began = time.perf_counter()
    secrets.spans("eyJ" * 400_000 + ".eyJ")
    assert time.perf_counter() - began < 2


def test_few_new_blobs_and_none(spark):
    """The same ledger, whether unseen blobs go to the texts or meet them, and nothing written when nothing is new."""
    for few in (0, 100):
        path = fresh_path(spark, "ledger")
        ledger = secrets.Ledger(spark, path, few=few)
        secrets.scan_paths(docs_of(spark, SECRETS), ledger)
        n = ledger.scanned().count()
        secrets.scan_paths(docs_of(spark, SECRETS * 2), ledger)
        assert ledger.scanned().count() == n
        got = secrets.digests(secrets.scan_paths(docs_of(spark, [*SECRETS, "token=freshone", "token=freshone"]), ledger)).where("spans like '%assign:0:14%'").count()
        assert got == 2 and ledger.scanned().count() == n + 1


# near-duplicates


def brute_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        same = (texts[a] or "") == (texts[b] or "")
        if same or (sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(texts))]


def copies(seed=5, groups=6, size=60):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(5000)
    texts = [None, "", "   ", "one two", "one two", "two one", "a b c d e", " ".join(word() for _ in range(3000))]
    for g in range(groups):
        base = [word() for _ in range(30 + 40 * g)]
        for _ in range(size if g == 0 else 8):
            own = list(base)
            for _ in range(r.randrange(0, 2 + len(own) // 25)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [" ".join([*(word() for _ in range(20)), *("shared passage %d" % k for k in range(10))]) for _ in range(30)]
    texts += [texts[-1], texts[7], "rep " * 400, "rep " * 401 + "x"]
    return texts


@pytest.mark.parametrize("settings", [neardup.Settings(), neardup.Settings(rounds=1, spread=4), neardup.Settings(rounds=0)])
def test_classes_against_brute_force(spark, settings):
    texts = copies()
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, texts), settings).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts)


def test_only_texts_of_candidates_are_shuffled(spark):
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        time.sleep(0.5)  # the store takes in what tasks wrote every 0.1 s
        found = context.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    r = random.Random(9)
    texts = [" ".join(f"{r.getrandbits(400):0100x}" for _ in range(100)) for _ in range(300)]
    texts[200] = texts[7] + " more"
    docs = docs_of(spark, texts).repartition(4).write.parquet(path := fresh_path(spark, "docs")) or spark.read.parquet(path)
    before = shuffled()
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(docs).collect()}
    assert shuffled() - before < sum(map(len, texts)) / 2
    assert got == {k: 7 if k == 200 else k for k in range(300)}


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15, 64])
def test_bitmap_loses_no_key(spark, bits):
    rows = spark.range(40_000).select(F.when(F.col("id") > 0, F.col("id")).alias("a"), F.col("id").cast("string").alias("b"))
    keys = rows.where("a is null or a % 10 = 0").select(F.col("a").alias("x"), F.col("b").alias("y"))
    kept = {tuple(x) for x in neardup._likely(rows, ["a", "b"], keys.unionAll(keys), neardup.Settings(bits=bits)).collect()}
    assert {tuple(x) for x in keys.collect()} <= kept
    assert len(kept) < 4500 + 36_000 * (bits < 1 << 26)
    assert neardup._likely(rows, ["a"], keys.select("x").limit(0), neardup.Settings()).count() == 0
    assert neardup._likely(rows.limit(0), ["a"], keys.select("x"), neardup.Settings()).count() == 0


def test_repeated_lines_cost_no_links(spark):
    """Near copies of set similarity 0.8 or more in which a line stands once and a thousand times."""
    r = random.Random(8)
    texts = []
    for k in range(40):
        head, line = (["w%d" % r.randrange(10**6) for _ in range(n)] for n in (44, 20))
        tail = ["w%d" % r.randrange(10**6) for _ in range(k % 2 * 8)]
        texts += [" ".join(head + line + line[:4]), " ".join(head + line * 1000 + tail)]  # every shingle of the line once
    expected = brute_classes(texts)
    assert expected == [k // 2 * 2 for k in range(len(texts))]
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == expected


def test_deduplicated_keeps_one_of_each(spark):
    texts = copies(groups=2, size=10)
    docs = docs_of(spark, texts)
    kept = neardup.deduplicated(docs.unionAll(docs.limit(5)))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(texts)))
    nulls = spark.createDataFrame([(None, "p q r s t", None, None, None, None), (None, "p q r s t", None, None, None, None)], DOCS)
    assert neardup.deduplicated(nulls).count() == 1 and neardup.near_duplicates(nulls).count() == 2
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_probability_jaccard_estimate():
    m = 1024
    a = {k: 1 + k % 3 for k in range(300)}
    b = {k: 1 + (k % 4) for k in range(60, 360)}
    hashes = lambda d: mix(np.array(list(d), np.uint64))
    doc = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
    weights = np.array([*a.values(), *b.values()], float)
    s = probminhash.sketch(doc, np.concatenate([hashes(a), hashes(b)]), weights, 2, m)
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in set(a) | set(b)) for i in set(a) & set(b))
    assert abs((s[0] == s[1]).mean() - exact) < 4 * (exact * (1 - exact) / m) ** 0.5
    one = probminhash.sketch(np.zeros(1, np.int64), np.array([7], np.uint64), np.ones(1), 1, m)
    assert (one == 7).all()


def test_shingles_do_not_cross_documents():
    texts = [b"a b c d e f", b"", b"x y", b"a b c d e"]
    doc, h = shingles(Words(texts), 5)
    assert list(doc) == [0, 0, 2, 3] and h[0] == h[3] and len(set(h.tolist())) == 3


# decontamination


def test_passages(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (12, 30, 60, 4)] + [None]
    edited = items[1].split()
    edited[10:12] = ["quite", "other", "words"]
    texts = [" ".join(word() for _ in range(40)) for _ in range(8)]
    texts += [f"{texts[0]} {items[0]} {texts[1]}", f"{texts[2]} {' '.join(edited).upper()}, {texts[3]}", items[2], f"ü {items[3]}", None, "", items[2]]
    bench = spark.createDataFrame([(k, t, 0) for k, t in enumerate(items)], "item_id long, text string, score int")
    docs = docs_of(spark, texts)
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.passages(docs, bench).collect()}
    # the item of four words only where it stands as a whole, and it is no reason to drop a document
    assert set(got) == {(8, 0), (9, 1), (10, 2), (14, 2), (11, 3)}
    assert texts[11][got[11, 3]["start"] : got[11, 3]["end"]] == items[3]
    assert got[8, 0]["share"] == 1.0 and texts[8][got[8, 0]["start"] : got[8, 0]["end"]] == items[0]
    assert decontaminate.clean(docs, bench).count() == len(texts) - 4
    assert decontaminate.clean(docs, bench).columns == docs.columns
    small = decontaminate.Settings(block_bytes=100)
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.passages(docs, bench, small).collect()} == set(got)
    assert decontaminate.passages(docs, bench.limit(0)).count() == 0 and decontaminate.passages(docs.limit(0), bench).count() == 0


def smith_waterman(item, words):
    above, best = [0] * (len(words) + 1), 0
    for a in item:
        row = [0]
        for j, b in enumerate(words):
            row.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, row[j] - 1))
        above, best = row, max(best, *row)
    return best


def test_spread_edits_against_brute_force(spark):
    """Copies with every n-th word replaced, alone or beside verbatim copies, and with only common n-grams left."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randrange(3, 8)))
    noise = lambda n: [word() for _ in range(n)]
    items = [noise(r.randrange(16, 60)) for _ in range(12)]
    texts = []
    for k, item in enumerate(items):
        for every in (4, 5, 7):
            shift = r.randrange(every)
            copy = [word() if j % every == shift else w for j, w in enumerate(item)]
            texts.append(noise(30) + copy + noise(30))
        if k % 3 == 0:
            texts += [noise(20) + item + noise(20)] * 2
        if k % 3 == 1:
            texts += [noise(5) + item[j : j + 3] + noise(5) for j in range(0, len(item) - 3) if r.random() < 0.8]
    expected = {(d, k) for d, t in enumerate(texts) for k, x in enumerate(items) if smith_waterman(x, t) >= 2 * min(0.5 * len(x), 40)}
    assert len(expected) >= 3 * len(items)
    docs = docs_of(spark, [" ".join(t) for t in texts])
    bench = spark.createDataFrame([(k, " ".join(t), 0) for k, t in enumerate(items)], "item_id long, text string, score int")
    for settings in (decontaminate.Settings(), decontaminate.Settings(hits=3, cells=500)):
        assert {(x["doc_id"], x["item_id"]) for x in decontaminate.passages(docs, bench, settings).collect()} == expected
    assert decontaminate.clean(docs, bench).count() == len(texts) - len({d for d, _ in expected})


def test_alignment_against_brute_force():
    r = np.random.default_rng(1)
    for _ in range(20):
        item, window = r.integers(0, 5, 9).astype(np.uint64), r.integers(0, 5, 17).astype(np.uint64)
        h = np.zeros((10, 18), int)
        for i in range(9):
            for j in range(17):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if item[i] == window[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(item, window[None, :])[0][0] == h.max()


# media


def test_payloads_round_trip(spark):
    r = random.Random(4)
    texts = [None, "", "x", "ÿ" * 288, "a" * 576, "é𝄞" * 999, "".join(chr(r.randrange(32, 0x2000)) for _ in range(3000)), "x"]
    stored = media.store(docs_of(spark, texts))
    rows = media.describe(stored).collect()
    for row in rows:
        raw = (texts[row["doc_id"]] or "").encode()
        assert row["n_bytes"] == len(raw) and row["thumbnail"] == media.payload_of(raw) and row["error"] is None
        assert row["width"] == 192 and row["height"] * 3 == len(row["thumbnail"])
    assert len({(r["media"], r["average_hash"], r["difference_hash"]) for r in rows if r["text"] == "x"}) == 1
    broken = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray(rows[0]["media"][:-9]))], "doc_id long, media binary")
    got = {x["doc_id"]: x["error"] for x in media.describe(broken).collect()}
    assert got[1] and got[2] is None and got[3]
    assert media.store(docs_of(spark, ["a"]).limit(0)).count() == 0


def bits_of(codes):
    return "".join(format(v, f"0{n}b") if n else "" for v, n in codes)


def test_other_baseline_files():
    """A file of three components, 2x2 sampled, with AC content and other tables, written by hand."""
    r = random.Random(6)
    quant = bytes([0]) + bytes([16] * 64)
    dc_table, ac_table = bytes([0, 0, 0, 0, 12] + [0] * 11) + bytes(range(12)), None
    symbols = [0x00, 0xF0, *[run << 4 | size for run in range(3) for size in range(1, 5)]]
    ac_table = bytes([0, 0, 0, 0, len(symbols)] + [0] * 11) + bytes(symbols)
    width, height = 40, 24
    across, down = 3, 2
    last, values, bits = [0, 0, 0], {0: [], 1: [], 2: []}, ""
    for _ in range(across * down):
        for c, n in ((0, 4), (1, 1), (2, 1)):
            for _ in range(n):
                v = r.randrange(-60, 60)
                d, last[c] = v - last[c], v
                values[c].append(v)
                size = abs(d).bit_length()
                bits += format(size, "05b") + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "")
                k = 1
                while k < 40:
                    s = r.choice(symbols[1:])
                    step = 16 if s == 0xF0 else (s >> 4) + 1
                    if k + step > 63:
                        break
                    bits += format(symbols.index(s), "05b") + "".join(r.choice("01") for _ in range(s & 15 if s != 0xF0 else 0))
                    k += step
                bits += format(0, "05b")
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    frame = bytes([8, 0, height, 0, width, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    data = b"\xff\xd8" + seg(0xFE, b"comment") + seg(0xDB, quant) + seg(0xC0, frame) + seg(0xC4, b"\x00" + dc_table + b"\x10" + ac_table) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (w, h, thumb), = jpeg.thumbnails([data])[0]
    assert (w, h) == (width, height) and thumb.shape == (3, 5)
    grid = np.zeros((down * 2, across * 2))
    for unit in range(across * down):
        for k in range(4):
            grid[unit // across * 2 + k // 2, unit % across * 2 + k % 2] = values[0][unit * 4 + k]
    assert (thumb == np.clip(np.rint(grid[:3, :5] * 16 / 8) + 128, 0, 255)).all()


# classifiers


def folds(rows, parts, part):
    return [r for r in rows if (zlib.crc32(str(r["doc_id"]).encode()) % parts == part)]


def test_language_held_out(spark):
    out = langid.op7_language(spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = folds(out, 3, 1)
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in out if r["held_out"]}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in out)


def test_language_cases(spark):
    docs = docs_of(spark, ["hello there friends", None, "123 !!", ""] + ["the cat and the dog"] * 5)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[0][0] == "en"
    none = langid.fit(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert langid.identified(docs, none).where("lang_pred <> 'und'").count() == 0
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 6 and kept.first()["score"] == "own"
    assert langid.accepted(docs.limit(0)).count() == 0
    long = "ab " * 120_000
    whole, parts = langid.gram_counts(long, langid.Settings()), langid.gram_counts(long, langid.Settings(block=1000))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def judged(out, labels, name):
    known = {r["doc_id"]: r[name] for r in labels}
    return [(r["score"], r["predicted"], known[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in known]


def test_quality_held_out(spark):
    rows = judged(quality.op2_quality(spark, DATA).collect(), table(spark, DATA, "labels").collect(), "quality")
    assert len(rows) > 40 and np.mean([p == y for _, p, y in rows]) > 0.9


def test_toxicity_held_out(spark):
    rows = judged(toxicity.op5_toxicity(spark, DATA).collect(), table(spark, DATA, "labels").collect(), "toxic")
    toxic, plain = [s for s, _, y in rows if y == 1], [s for s, _, y in rows if y == 0]
    assert np.mean([a > b for a in toxic for b in plain]) > 0.8 and np.mean([p == y for _, p, y in rows]) > 0.85
    assert len(set(toxic)) > len(toxic) / 2  # texts without a telling stretch have scores of their own


@pytest.mark.parametrize("module, name, scores", [(quality, "quality", "quality_score"), (toxicity, "toxic", "toxicity")])
def test_classifier_cases(spark, module, name, scores):
    docs = docs_of(spark, [None, "", "word " * 5, "x" * 200_000, "word " * 5])
    few = spark.createDataFrame([(2, 1), (3, 1), (None, 1)], f"doc_id long, {name} int")
    for labels in (few, few.limit(0), few.unionAll(spark.createDataFrame([(3, 0), (1, 0)], few.schema))):
        model = module.fit(docs, labels, F.lit(True))
        out = {r["doc_id"]: r[scores] for r in module.scored(docs, model).collect()}
        assert len(out) == 5 and all(0 <= s <= 1 for s in out.values()) and out[2] == out[4]
    assert module.scored(docs.limit(0), model).count() == 0


def test_network_gradient():
    s = quality.Settings(filters=3, hidden=4, chunk=8, width=3)
    n = quality.Network(s)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    n.p["bias"] += 0.3
    data, y = np.random.default_rng(0).integers(97, 110, (5, 18)).astype(np.uint8), np.array([0, 1, 1, 0, 1.0])

    def loss():
        total = 0
        for row, label in zip(data, y):
            parts = sum(n.p["table"][k][row[k : k + 16]] for k in range(3)).reshape(4, 4, 3).max(axis=1)
            chunks = np.maximum(np.maximum(parts[:-1], parts[1:]) + n.p["bias"], 0)
            z = np.maximum(chunks @ n.p["mix"] + n.p["shift"], 0).max(axis=0) @ n.p["out"] + n.p["base"][0]
            total += np.log1p(np.exp(-z if label else z))
        return total / len(y)

    g = n._gradients(list(data), y)
    for name in g:
        flat, found = n.p[name].reshape(-1), np.asarray(g[name], float).reshape(-1)
        at = int(np.abs(found).argmax())
        before = flat[at]
        flat[at] = before + 1e-5
        up = loss()
        flat[at] = before - 1e-5
        down = loss()
        flat[at] = before
        assert (up - down) / 2e-5 == pytest.approx(found[at], rel=1e-3, abs=1e-6)
