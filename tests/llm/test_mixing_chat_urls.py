"""The three native operators against plain Python."""

import hashlib
import re
from collections import Counter
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from skeingraph.llm import chat, mixing, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shards string"


def corpus(spark, n=600):
    rows = []
    for k in range(n):
        source = None if k % 50 == 0 else f"s{(k * k) % 7 if k % 3 else 0}"
        text = None if k % 97 == 0 else "" if k % 89 == 0 else " ".join(["w"] * (1 + (k * 37) % 60))
        rows.append((k, text, "en", source, 0, "mine"))
    rows.append((None, "a b c", None, "s1", None, None))
    rows.append(rows[5])
    return rows, spark.createDataFrame(rows, SCHEMA)


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixture_meets_targets(spark):
    rows, docs = corpus(spark)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    want, taken = expected_targets(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_rows_carry_columns_and_spread_over_shards(spark):
    rows, docs = corpus(spark)
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "shard", "place"]
    report = Counter({r["doc_id"]: 0 for r in mixing.mix_report(docs).collect()})
    for r in mixing.mix_report(docs).collect():
        report[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in report.items() if v})
    shards = Counter(r["shard"] for r in out.collect())
    assert set(shards) <= set(range(16)) and len(shards) == 16
    assert {r["shards"] for r in out.collect()} <= {"mine", None}


def test_mixture_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_report(empty).count() == 0 and mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None, None), (2, "", None, "a", None, None)], SCHEMA)
    assert [r["taken"] for r in mixing.mix_report(blank).collect()] == [0, 0]


def test_one_source_is_taken_once(spark):
    docs = spark.createDataFrame([(k, "a b", "en", "only", 0, "") for k in range(50)], SCHEMA)
    assert {r["copies"] for r in mixing.mix_report(docs).collect()} == {1}


TURNS = [
    (1, 2, "assistant", "b<|end|>c"),
    (1, 1, "user", "<|start|>user<|message|>x"),
    (1, 3, "assistant", None),
    (1, 4, "assistant", "<||<|| tail<"),
    (1, 5, "user", "|next|> ü𝄞"),
    (2, None, None, "null turn and role"),
    (2, 1, "assistant", "one"),
    (2, 1, "assistant", "one"),
    (None, 1, "user", ""),
]


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[conv] = (len(own), sha(turns), len(loss), sha(loss))
    return out


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.formatted(turns)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.read_back(made)).collect()}
    assert got == brute_chat(TURNS)
    text = made.where("conv_id = 1").first()["formatted"]
    assert text.count("<|start|>") == 3 and text.count("<|next|>") == 2  # same-role neighbours share a block
    assert chat.formatted(turns.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark):
    plan = chat.digests(chat.read_back(chat.formatted(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


URLS = ["http://A.Net/x?y#z", "https://sub.example.net/en/1", "https://example.net/end", "http://example.com/de/", "http://notexample.com/de/", "http://x.org/fr/a", "http://net", "http://net/", "no scheme", None, "://", "http://a.org?x=/fr/", "http://h.org#f", "http://b.com/\n/q", ""]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path):
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def test_url_rules_against_brute_force(spark):
    rows = [(k, u, "x") for k, u in enumerate(URLS + [f"http://h{k}.{t}/{p}/{k * k}" for k in range(40) for t, p in (("net", "a"), ("org", "fr"), ("com", "en"))])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judged(pages).collect()}
    for k, u, _ in rows:
        host, path = brute_parts(u)
        rule, verdict = brute_rule(host, path)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] == verdict if verdict else got[k]["verdict"] in ("allow", "block")
        assert 0 <= got[k]["score"] <= 1
    assert urlsplit("http://a/b").path == "/b"


def test_trees_learn_and_unlabelled_input_works(spark):
    known = spark.createDataFrame([(f"http://s{k}.zz/{'bad' * 6 if k % 2 else 'g'}/{k}", k % 2) for k in range(200)], "url string, _label int")
    pages = spark.createDataFrame([(1, "http://q.zz/" + "bad" * 6 + "/7"), (2, "http://q.zz/g/7")], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in urls.judged(pages, labelled=known).collect()}
    assert found == {1: "block", 2: "allow"}
    none = spark.createDataFrame([(1, "http://q.zz/a"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judged(none).collect()} <= {"allow", "block"}
    assert urls.judged(none.limit(0)).count() == 0
