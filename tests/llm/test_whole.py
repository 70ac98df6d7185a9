"""The whole job where a registered query or a bounded sample did a part of it."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from datetime import datetime, timezone

from pyspark.sql import functions as F

import __spark_entry__ as driver
from glyphmill.llm import pii, queries, urllists


# -- 8: list entries from all events ----------------------------------------------


def test_every_event_makes_a_list_entry(spark, sf_dir):
    events, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "pages"))
    rows = events.select("event_id", "event_type", "ts").collect()
    entries = queries.list_entries(events, pages).collect()
    assert len(entries) == len(rows)
    assert sorted(e["at"] for e in entries) == sorted(r["ts"] for r in rows)

    # As-of state by brute force: what each list says about a host when the page was fetched.
    found = pages.select("page_id", urllists.host(pages["url"]).alias("host")).collect()
    hosts = sorted({p["host"] for p in found if p["host"]}, key=lambda h: hashlib.md5(h.encode()).hexdigest())
    dated = defaultdict(list)
    for r in rows:
        name, kind, action = queries.LIST_ACTIONS[r["event_type"]]
        micros = r["ts"].replace(tzinfo=r["ts"].tzinfo or timezone.utc)
        dated[hosts[r["event_id"] % len(hosts)], name, kind].append((micros, action == "add"))
    got = {r["page_id"]: r for r in driver.queries()["op8_temporal_url_lists"](spark, sf_dir).collect()}
    assert len(got) == len(found)
    states = set()
    for p in found:
        second = 1_704_067_200 + p["page_id"] * 7919 % 2_592_000
        labels = (p["host"] or "").split(".")
        suffixes = {".".join(labels[i:]) for i in range(len(labels))}
        active = set()
        for (host, name, kind), changes in dated.items():
            before = [c for c in changes if c[0] < datetime.fromtimestamp(second + 1, timezone.utc)]
            if host in suffixes and before and max(before)[1]:
                active.add((name, kind, host))
        row = got[p["page_id"]]
        kinds = {k for _, k, _ in active}
        assert row["n_matches"] == len(active), p
        assert row["lists"] == ",".join(sorted({n for n, _, _ in active}))
        assert row["blocked"] == ("block" in kinds and "allow" not in kinds)
        states.add((p["host"], row["lists"]))
    assert len(states) > len(hosts)
    # Entries cover the month, and most captures lie between two of them.
    times = sorted(e["at"].replace(tzinfo=timezone.utc).timestamp() for e in entries)
    assert times[-1] - times[0] > 27 * 86_400
    seconds = [1_704_067_200 + p["page_id"] * 7919 % 2_592_000 for p in found]
    assert sum(times[0] < t < times[-1] for t in seconds) > 0.5 * len(seconds)


# -- 4: thresholds over all candidates ---------------------------------------------


def numbers_and_secrets(spark, secrets=40, plain=600, numbers=30):
    """Texts rich in numbers, few of which hold a secret."""
    rng = random.Random(3)
    texts = []
    for i in range(plain):
        words = " ".join(f"{rng.randint(1, 28)}.{rng.randint(1, 12)} for {rng.randint(100, 999)}" for _ in range(numbers))
        if i < secrets:
            words += ' token = "' + "".join(rng.choice("abcdef0123456789") for _ in range(40)) + '"'
        elif i < 2 * secrets:
            words += " mode = " + "".join(rng.choice("ghijkl") for _ in range(14))
        texts.append((i, f"{words} +1 (168) 555-{rng.randint(1000, 9999)}"))
    return spark.createDataFrame(texts, "doc_id bigint, text string")


def test_a_rare_kind_keeps_its_threshold_beside_many_numbers(spark):
    docs = numbers_and_secrets(spark).cache()
    p = pii.Params(max_candidates=300)
    model = pii.fit(docs, p)
    assert "secret" in model.thresholds
    added = pii.find(docs, model).filter(F.exists("added", lambda s: s["kind"] == "secret"))
    assert sorted(r["doc_id"] for r in added.select("doc_id").collect()) == list(range(40))


def test_the_sample_is_bounded_and_thresholds_count_every_candidate(spark):
    docs = numbers_and_secrets(spark)
    p = pii.Params(max_candidates=300)
    rows = pii.labelled_candidates(docs)
    sample = rows.filter(pii.in_sample(rows, p)).groupBy("generator", "y").count().collect()
    assert {(r["generator"], r["y"]) for r in sample} >= {("number", 0.0), ("number", 1.0), ("secret", 0.0), ("secret", 1.0)}
    assert all(r["count"] <= 100 for r in sample)
    # The trained ones are stood for by the rest; a group that was trained on as a whole counts itself.
    found = [
        {"generator": "secret", "y": 1.0, "trained": True, "step": 0.9, "n": 2},
        {"generator": "secret", "y": 0.0, "trained": False, "step": 0.1, "n": 9},
        {"generator": "number", "y": 1.0, "trained": True, "step": 0.9, "n": 50},
        {"generator": "number", "y": 1.0, "trained": False, "step": 0.9, "n": 49},
        {"generator": "number", "y": 0.0, "trained": False, "step": 0.9, "n": 1},
        {"generator": "number", "y": 0.0, "trained": False, "step": 0.7, "n": 1},
    ]
    assert pii._thresholds(found, p) == {"secret": 0.9, "number": 0.9}


def test_each_generator_adds_what_the_base_patterns_miss(spark):
    rng = random.Random(5)
    letters = "abcdefghiklmnoprstu"

    def name():
        return "".join(rng.choice(letters) for _ in range(6))

    texts = []
    for i in range(600):
        a, b, c = rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999)
        texts.append(f"chapter {rng.randint(1, 99)}.{i}, {c} of {a * b} lines, @{name()} said x@{name()} on {c}-{b % 12 + 1}-11")
        texts.append(f"write {name()}@{name()}.com or +1 ({a}) 555-{c}; from {a} to {b}")
        texts.append(f'set token = "{rng.randbytes(20).hex()}" here, mode = {name()}{name()}{name()}')
        if i % 3 == 0:
            texts.append(f"call me: ({a}) {b}-{c} or {a}-{b}-{c}, id {a}-{c % 90 + 10}-{c} now")
            texts.append(f"mail jörg.{name()}@{name()}.com, {name()}@müller-{name()}.de ok")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = pii.fit(docs)
    assert set(model.thresholds) == set(pii.GENERATORS)
    probe = [
        "phone (555) 123-4567 and id 123-45-6789 here",
        "reach jörg@example.com today",
        "reach anna@bücher.de today",
        "reach anna@example.com, or",
        'my token = "0401e44b4045d5b7fc925af2d5b1396433e9ee50" ok',
        "from 200 to 310, lines 12 of 4000",
    ]
    rows = spark.createDataFrame(list(enumerate(probe)), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in pii.find(rows, model).collect()}
    added = [[(s["kind"], probe[i][s["start"] : s["end"]]) for s in found[i]["added"]] for i in range(len(probe))]
    assert added == [
        [("number", "(555) 123-4567"), ("number", "123-45-6789")],
        [("address", "jörg@example.com")],
        [("address", "anna@bücher.de")],
        [],
        [("secret", "0401e44b4045d5b7fc925af2d5b1396433e9ee50")],
        [],
    ]
    assert [s["kind"] for s in found[1]["base"]] == ["email"]
    done = {r["doc_id"]: r["redacted"] for r in pii.redact(rows, model).collect()}
    assert done[1] == "reach [address] today" and done[3] == "reach [email], or"
