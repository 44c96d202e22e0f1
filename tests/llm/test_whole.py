"""Inputs for which operators once did less than the whole job."""

import random
import string
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import _common, fingerprints, mixing, neardup, quality, secrets
from tessera.operators import tables
from tests.llm.test_operators import shingles

ALPHABETS = {"upper hex": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "lower": string.ascii_lowercase + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base62": string.ascii_letters + string.digits}


@pytest.mark.parametrize("alphabet", sorted(ALPHABETS))
def test_random_strings_of_any_length_are_novel(alphabet):
    r = random.Random(alphabet)
    for size in (16, 20, 32, 40, 48, 64, 100, 128, 300, 512, 1000, 2000):
        found = 0
        for _ in range(20):
            word = "A7" + "".join(r.choice(ALPHABETS[alphabet]) for _ in range(size - 2)) if alphabet != "lower" else "a7" + "".join(r.choice(ALPHABETS[alphabet]) for _ in range(size - 2))
            text = f"the signing secret is {word} as of today"
            base = secrets.base_spans(text)
            found += secrets.novel_spans(text, base, 40, 400, 0.9) == [(22, 3, 22 + size)] or bool(base)
        assert found == 20, size


def test_strings_without_news_are_not_novel():
    for word in ("A" * 40 + "1", "a1A" * 30, "0A" * 200, "C0FFEE" * 10, "default_placeholder_example_value1", "0123456789" + string.ascii_uppercase + string.ascii_lowercase):
        assert secrets.novel_spans(f"the token is {word}", [], 40, 400, 0.9) == []


def test_lines_of_a_private_key(spark):
    r = random.Random(4)
    lines = ["".join(r.choice(ALPHABETS["base64"]) for _ in range(64)) for _ in range(5)] + ["q8Zk3w=="]
    head, tail = "-----BEGIN RSA PRIVATE KEY-----\n", "-----END RSA PRIVATE KEY-----\nmore text"
    whole = head + "\n".join(lines) + "\n" + tail
    texts = [whole, whole.replace("\n", "\\n"), whole.replace("\n", "\r\n"), head + "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n" + "\n".join(lines) + "\n" + tail, head + "\n".join(lines)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secrets.redact(docs).collect():
        assert not any(x in row["text"] for x in lines), row["doc_id"]
        assert row["text"].startswith(head[:-1]) and row["doc_id"] == 4 or row["text"].endswith("more text")
    text = head + "put your own key here\n" + tail
    assert secrets.novel_spans(text, [], 40, 400, 0.9) == []


def some_words(r, letters, n=60):
    return " ".join(r.choice([a + b for a in letters for b in letters][:10]) for _ in range(n))


def test_small_languages_train_and_calibrate_the_pooled_model(spark):
    """One language of 100 trusted texts, two of 30, and one whose texts are long."""
    r = random.Random(6)
    letters = {"en": "abcd", "de": "mnop", "es": "wxyz", "fr": "ghij"}
    rows = [(lang, some_words(r, letters[lang], 9_000 if lang == "fr" else 60)) for lang, n in (("en", 100), ("de", 30), ("es", 30), ("fr", 4)) for _ in range(n)]
    rows += [(lang, some_words(r, "0123#%&")) for lang in ("de", "es")]
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string")
    labels = docs.where(f"doc_id < {len(rows) - 2}").select("doc_id", F.lit(1).alias("quality"))
    got = {x["doc_id"]: x for x in quality.quality(docs, labels).collect()}
    for i, (lang, _) in enumerate(rows[:-2]):
        assert got[i]["perplexity"] < 30, (lang, got[i])
    for lang in letters:
        assert sum(got[i]["kept"] for i, (own, _) in enumerate(rows[:-2]) if own == lang) >= 0.9 * sum(own == lang for own, _ in rows[:-2]), lang
    assert not any(got[len(rows) - k]["kept"] for k in (1, 2))


def test_quality_of_small_languages_only(spark):
    r = random.Random(7)
    rows = [(i, some_words(r, letters), lang) for i, (lang, letters) in enumerate([("a", "abcd"), ("b", "mnop"), ("c", "wxyz"), (None, "ghij")] * 39)]
    docs = spark.createDataFrame([*rows, (500, some_words(r, "0123#%&"), "a"), (501, " \n", "a")], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in quality.quality(docs, docs.where("doc_id <> 500").select("doc_id", F.lit(1).alias("quality"))).collect()}
    assert all(x["perplexity"] is not None for d, x in got.items() if d != 501)
    assert sum(got[i]["kept"] for i in range(len(rows))) >= 0.95 * len(rows) and not got[500]["kept"] and not got[501]["kept"]
    blank = docs.select("doc_id", F.lit(" \t").alias("text"), "lang")
    assert not any(x["kept"] for x in quality.quality(blank, docs.select("doc_id", F.lit(1).alias("quality"))).collect())


def test_near_duplicate_stage_at_four_fifths(spark):
    """Pairs with a similarity of 0.79 to 0.86: from 0.8 on one stays."""
    r = random.Random(8)
    rows, true = [], set()
    for k in range(60):
        own = [f"w{r.randrange(10**6)}" for _ in range(200)]
        texts = [" ".join(own), " ".join(own[: -(k % 30)] + [f"x{r.randrange(10**6)}" for _ in range(k % 30)]) if k % 30 else " ".join(own)]
        a, b = map(shingles, texts)
        rows += [(2 * k + j, text, "en", "s", len(text)) for j, text in enumerate(texts)]
        true |= {2 * k} if 5 * len(a & b) >= 4 * len(a | b) else {2 * k, 2 * k + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == true


def test_mix_stays_at_the_exact_weights():
    for weights in ({"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, {"a": 0.0001, "b": 0.9999}, {f"s{k}": 1.0 for k in range(20)}, {f"s{k}": (k + 2) ** 0.5 for k in range(7)}):
        total = sum(map(Fraction, weights.values()))
        exact = {s: Fraction(w) / total for s, w in weights.items()}
        places = mixing.places({s: int(40_000 * w) + 1 for s, w in exact.items()}, weights)
        assert sorted(x for own in places.values() for x in own) == list(range(sum(map(len, places.values()))))
        end = min(own[-1] for own in places.values())  # until the first source is through
        for s, own in places.items():
            for i, slot in enumerate(own):
                if slot <= end:
                    assert i + 1 - (slot + 1) * exact[s] < 1 and slot * exact[s] - i < 1, (weights, s, i)


def test_mix_goes_on_when_sources_are_through():
    places = mixing.places({"a": 3, "b": 500, "c": 90}, {"a": 1.0, "b": 1.0, "c": 2.0})
    assert sorted(x for own in places.values() for x in own) == list(range(593))
    assert all(list(own) == sorted(own) for own in places.values())


def test_mix_of_many_blocks(spark, monkeypatch):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source")
    rows = {tuple(x) for x in mixing.mix(docs, block=2).collect()}
    assert sorted(x[-1] for x in rows) == list(range(30_000))
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 10)
    assert rows == {tuple(x) for x in mixing.mix(docs, block=2).collect()}


def test_near_duplicates_gather_no_table_that_grows(spark):
    """Whatever the session's threshold, no table of ids is broadcast from the driver."""
    docs = spark.createDataFrame([(i, some_words(random.Random(i // 2), "abcd")) for i in range(40)], "doc_id long, text string")
    out = neardup.near_duplicates(docs)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sum(x["kept"] for x in out.collect()) == 20


def test_stored_tables_release_the_drivers_memory(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(tables, "_trim", lambda sc: calls.append(sc))
    monkeypatch.setattr(tables, "_released", {})
    for _ in range(2):
        assert tables.stored(spark.range(3), "few").count() == 3
    assert len(calls) == 1  # RELEASE_S apart
    monkeypatch.undo()
    assert tables._trim(spark.sparkContext) in (True, False)


def test_single_words_come_with_the_parameters():
    """Samples by their definition, where most or all words are single and over more than a slice of terms."""
    r = np.random.default_rng(1)
    for n, most in ((1, 1), (1, 5), (50, 1), (300, 4), (5000, 3)):
        terms, counts = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)), r.integers(1, most + 1, n)
        weights = (1 + np.log(counts)).astype(np.float32)
        u, b, c = fingerprints.gammas(terms, 64)
        t = np.floor(np.log(weights[:, None]) / u + b)
        k = (c - u * (t - b + 1)).argmin(axis=0)
        level = t[k, np.arange(64)].astype(np.int64).view(np.uint64)
        want = np.maximum((fingerprints.mix(terms[k] ^ (level * fingerprints.GOLD)) >> np.uint64(32)).astype(np.uint32), 1)
        assert (fingerprints.sample(terms, weights, fingerprints.with_single(u, b, c), np.arange(n), 64) == want).all()


def test_components_in_one_task_are_those_of_the_rounds(spark, monkeypatch):
    """Chains, stars and a tree of random links: a few links need two tables, and both ways find the same."""
    r = random.Random(9)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(50)] + [(2000 + r.randrange(i), 2000 + i) for i in range(1, 200)] + [(5, 5), (3001, 3000), (3000, 3001)]
    df = spark.createDataFrame(links, "a long, b long")
    found, labels, stored = [], [], _common.materialize
    monkeypatch.setattr(_common, "materialize", lambda df, label: labels.append(label) or stored(df, label))
    for few in (1 << 20, 60, 0):
        monkeypatch.setattr(_common, "FEW_EDGES", few)
        groups = {}
        for node, comp in _common.connected_components(df).collect():
            groups.setdefault(comp, set()).add(node)
        found.append(sorted(map(sorted, groups.values())))
        if len(found) == 1:
            assert labels == ["edges", "merged"]
    assert found[0] == [list(range(201)), list(range(1000, 1051)), list(range(2000, 2200)), [3000, 3001]]
    assert found[1] == found[0] and found[2] == found[0]


def test_the_drivers_heap_follows_what_it_holds(spark, monkeypatch):
    monkeypatch.setattr(tables, "_released", {})
    tables.stored(spark.range(3), "few")
    beans = spark._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    name = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    given, kinds = spark.sparkContext._gateway.new_array(spark._jvm.Object, 1), spark.sparkContext._gateway.new_array(spark._jvm.String, 1)
    given[0], kinds[0] = spark.sparkContext._gateway.new_array(spark._jvm.String, 0), "[Ljava.lang.String;"
    of = spark._jvm.java.lang.Class.forName
    types, asked = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Class, 4), spark.sparkContext._gateway.new_array(spark._jvm.Object, 4)
    for k, (kind, x) in enumerate((("javax.management.ObjectName", name), ("java.lang.String", "vmFlags"), ("[Ljava.lang.Object;", given), ("[Ljava.lang.String;", kinds))):
        types[k], asked[k] = of(kind), x
    flags = of("javax.management.MBeanServer").getMethod("invoke", types).invoke(beans, asked)
    assert all(f"-XX:{x}={n} " in flags for x, n in tables.HEAP.items())
