"""Operators against brute force, and on nulls, empty and long texts, ties, repeats, clashing columns."""

import functools
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import backoff, decontam, fingerprints, licenses, mixing, neardup, pii, quality, secrets, warc
from tessera.llm._common import mix

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, nid long, key long, h long, b long, found string"


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every oddity; the extra columns clash with names that operators use inside."""
    r = random.Random(3)
    base = words(r, 120)
    near = base.split()
    near[7] = "changed"
    long = words(r, 60_000)
    texts = [None, "", " \n\t", "one two", "one two", base, base.upper(), " ".join(near), long, long + " tail", "password = 'Zx81kQpL0aQ72mmz'", "é ü " * 40, "x" * 50_000, "1" * 30_000, "mail me: jo@ex.org or +1 (499) 555-6503"]
    rows = [(i * 3, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, 1, 2, 3, 4, "x") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, "en", "s1", 5, None, None, None, None, None), (7, None, "xx", "s0", 0, 1, 1, 1, 1, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or [tuple(w)]) if w else frozenset()


def components(rows, num=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    seen = {p for own in where.values() for p in itertools.combinations(own, 2)}
    for i, j in seen:
        if 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i))), d is not None and d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_brute_force(spark, odd, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    got = [(str(r[0]), r[1], str(r[2]), r[3]) for r in neardup.near_duplicates(docs, num=85, block=block).collect()]
    assert sorted(got) == components(pairs(docs))


def test_near_duplicates_of_a_large_group(spark):
    """Copies of one text, each with its own edits: some are linked only through others."""
    r = random.Random(1)
    base = words(r, 150).split()
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(150)] = words(r, 1)
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (512, 64):
        got = [(str(x[0]), x[1], str(x[2]), x[3]) for x in neardup.near_duplicates(docs, num=85, block=block).collect()]
        assert sorted(got) == components(rows)


def test_near_duplicates_deal_short_signatures(spark, monkeypatch):
    """What goes to pivots is a byte a coordinate, which no equal coordinates lose."""
    r = np.random.default_rng(5)
    a, b = r.integers(0, 1 << 32, (2, 500, 128), dtype=np.uint64).astype(np.uint32)
    b[:, :90] = a[:, :90]
    assert ((neardup.low_bytes(a) == neardup.low_bytes(b)).sum(axis=1) >= (a == b).sum(axis=1)).all()
    grouped, seen = neardup._grouped, []
    monkeypatch.setattr(neardup, "_grouped", lambda dealt, by_nid, keys: seen.append(by_nid) or grouped(dealt, by_nid, keys))
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join([*words[:20], f"x{k}", *words[20:]])) for k in range(12)], "doc_id long, text string")
    neardup.near_duplicates(docs, num=80).count()
    assert seen and all("sig" not in x.columns and x.selectExpr("max(octet_length(low))").first()[0] == 128 for x in seen)


def test_near_duplicates_odd(spark, odd, empty):
    docs = odd
    got = [(str(r[0]), r[1], str(r[2]), r[3]) for r in neardup.near_duplicates(docs, num=85).collect()]
    assert sorted(got) == components(pairs(docs))
    assert neardup.near_duplicates(empty).count() == 0


def test_signature_agreement_estimates_jaccard():
    a, b = mix(np.arange(1, 1001, dtype=np.uint64)), mix(np.arange(201, 1201, dtype=np.uint64))
    by = neardup.multipliers(1024)
    same = (neardup.signature(a, by) == neardup.signature(b, by)).mean()
    assert abs(same - 800 / 1200) < 0.06


def test_fingerprints(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(pairs(docs))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(docs, bucket_bytes=50_000).collect()}
    assert len(got) == len(rows)
    by_text = {}
    off = []
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = fingerprints.edited(t, nxt)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        bags = []
        for x in (t, e, nxt):
            w, c = np.unique(x.encode().lower().split() or [b""], return_counts=True)
            bags.append(dict(zip(w.tolist(), 1 + np.log(c), strict=True)))
        for other, est in ((bags[1], r["near_edited"]), (bags[2], r["near_next"])):
            keys = set(bags[0]) | set(other)
            true = sum(min(bags[0].get(k, 0), other.get(k, 0)) for k in keys) / sum(max(bags[0].get(k, 0), other.get(k, 0)) for k in keys)
            off.append(est - true)
    assert np.abs(off).max() < 0.3 and abs(np.mean(off)) < 0.01 and np.std(off) < 0.07
    whole = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}
    assert whole == {d: r["fingerprint"] for d, r in got.items()}
    assert fingerprints.fingerprint(odd, bucket_bytes=20_000).count() == odd.count()
    assert fingerprints.fingerprint(odd, batch_terms=100).select("doc_id", "fingerprint", "edited_fingerprint").exceptAll(fingerprints.fingerprint(odd).select("doc_id", "fingerprint", "edited_fingerprint")).count() == 0
    assert fingerprints.fingerprint(empty).count() == 0
    one = fingerprints.fingerprint(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()


def brute_backoff(rows, order, alpha, least):
    toks = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())) for d, t in rows]
    c = {}
    for _, w in toks:
        for n in range(1, order + 1):
            for i in range(len(w) - n + 1):
                c[tuple(w[i : i + n])] = c.get(tuple(w[i : i + n]), 0) + 1
    total = sum(len(w) for _, w in toks)
    out = []
    for d, w in toks:
        s = 0.0
        for i in range(len(w)):
            v = np.log(c[(w[i],)] / total)
            for n in range(2, min(order, i + 1) + 1):
                g = tuple(w[i - n + 1 : i + 1])
                v = np.log(c[g] / c[g[:-1]]) if c[g] >= least else v + np.log(alpha)
            s += v
        out.append((str(d), len(w), round(s, 4)))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_stupid_backoff(spark, odd, empty, order):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = backoff.stupid_backoff(docs, order=order, block_words=3000, shards=7).collect()
    mine, true = {}, {}
    for r in got:
        mine.setdefault(str(r[0]), []).append(r[2])
    for d, _, s in brute_backoff(pairs(docs), order, 0.4, 2):
        true.setdefault(d, []).append(s)
    assert all(np.allclose(sorted(mine[d]), sorted(true[d]), atol=1e-3) for d in true)
    assert backoff.stupid_backoff(empty).count() == 0
    same = spark.createDataFrame([(1, "a b a b")] * 4, "doc_id long, text string").repartition(4)
    assert {(r[1], round(r[2], 4)) for r in backoff.stupid_backoff(same, block_words=2).collect()} == {(4, round(float(np.log(0.5) + np.log(1) * 2 + np.log(4 / 8)), 4))}


def test_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r["kept"] for r in quality.quality(docs, labels).collect()}
    marked = {r[0]: r[1] for r in labels.select("doc_id", "quality").collect()}
    good, bad = ([got[d] for d in marked if marked[d] == q] for q in (1, 0))
    assert len(got) == docs.count() and np.mean(good) > 0.97 and np.mean(bad) < 0.3
    rows = quality.quality(odd, labels.withColumn("doc_id", F.col("doc_id") * 3)).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if not r["n_words"])
    assert quality.quality(empty, labels).count() == 0
    free = quality.quality(odd, labels.where("false")).collect()
    assert all(r["kept"] == (r["n_words"] > 0) and r["perplexity"] is None for r in free)


def brute_model(texts):
    """Interpolated modified Kneser-Ney by its definitions, in dicts: word -> token, and the probability after a context."""
    docs = [t.split() for t in texts if t.split()]
    often = {w for w in itertools.chain(*docs) if sum(d.count(w) for d in docs) >= 3}
    shape = lambda w: "\0" + quality.shape(w.encode()).decode()
    seqs = [[w if w in often else shape(w) for w in d] for d in docs]
    tokens = {"\0", *itertools.chain(*seqs)}
    count = lambda grams: {g: sum(1 for x in grams if x == g) for g in set(grams)}
    three = count([tuple(s[i : i + 3]) for s in seqs for i in range(len(s) - 2)])
    pairs = {tuple(s[i : i + 2]) for s in seqs for i in range(len(s) - 1)}
    two = {g: len({x[0] for x in three if x[1:] == g}) or 1 for g in pairs}
    one = {w: sum(g[1] == w for g in pairs) for w in tokens if any(g[1] == w for g in pairs)}

    def discounts(counts):
        n = [max(1, sum(c == k for c in counts.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return lambda c: min(max(raw[min(c, 3) - 1], 0.05), (0.95, 1.9, 2.9)[min(c, 3) - 1])

    d1, d2, d3 = map(discounts, (one, two, three))

    def p(w, *context):
        if not context:
            total = sum(one.values())
            return (one[w] - d1(one[w]) if w in one else 0) / total + sum(map(d1, one.values())) / total / len(tokens)
        counts, d = (two, d2) if len(context) == 1 else (three, d3)
        own = {g[-1]: c for g, c in counts.items() if g[:-1] == context}
        if not own:
            return p(w, *context[1:])
        total = sum(own.values())
        return (own[w] - d(own[w]) if w in own else 0) / total + sum(map(d, own.values())) / total * p(w, *context[1:])

    token = lambda w: w if w in often else shape(w) if shape(w) in tokens else "\0"
    return tokens, token, p


def test_kneser_ney_brute_force(spark):
    """Perplexities of each language, and of the pooled model, against the definitions; every model sums to one."""
    r = random.Random(2)
    letters = {"en": "abc", "de": "xyz", "fr": "mn"}
    text = lambda lang: " ".join(("A" if r.random() < 0.1 else "") + "".join(r.choice(letters[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 25)))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en"] * 24 + ["de"] * 16 + ["fr"] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = {x["doc_id"]: x for x in quality.quality(docs, labels, least=10, prior=0.0, shards=3, block_docs=5).collect()}
    trains = {x[0] for x in docs.where("pmod(xxhash64(41, doc_id), 1 << 30) / (1 << 30) < 0.5").collect()}
    own = {"en", "de"}
    for lang, of in (("en", {"en"}), ("de", {"de"}), ("fr", {"en", "de", "fr"})):
        tokens, token, p = brute_model([t for i, t, x in rows if x in of and i in trains])
        for context in ((), ("abc",), (next(iter(tokens)),)):
            assert sum(p(w, *context) for w in tokens) == pytest.approx(1)
        for i, t, x in rows:
            if (x if x in own else "fr") == lang:
                seq = [token(w) for w in t.split()]
                logs = [np.log(p(w, *seq[max(0, k - 2) : k])) for k, w in enumerate(seq)]
                assert got[i]["perplexity"] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-6), (lang, i)
    for lang in own:
        held = [np.log(got[i]["perplexity"]) for i, _, x in rows if x == lang and i not in trains]
        assert got[0 if lang == "en" else 24]["threshold"] == pytest.approx(np.exp(max(held) + 0.1), rel=1e-6)


def test_quality_counts_every_trusted_text(spark):
    """More and longer trusted texts than a model once took, in many blocks and shards; with hot n-grams and without."""
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abC") for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, text(r.randint(1, 8))) for i in range(1_300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trains = {x[0] for x in docs.where("pmod(xxhash64(41, doc_id), 1 << 30) / (1 << 30) < 0.5").collect()}
    assert len(trains) > 600
    long = min(trains)
    rows[long] = (long, " " + "the same again " * 1_400 + "and then a last part, after 20000 characters " * 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(3)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    found = [{x["doc_id"]: x for x in quality.quality(docs, labels, prior=0.0, **more).collect()} for more in ({"hot": 0, "shard_bytes": 2_000, "block_words": 300, "block_docs": 7, "round_rows": 500}, {"hot": 60, "round_rows": 9}, {})]
    _, token, p = brute_model([t for i, t in rows if i in trains])
    p = functools.cache(p)
    for i, t in [rows[long], *rows[:12]]:
        seq = [token(w) for w in t.split()]
        logs = [np.log(p(w, *seq[max(0, k - 2) : k])) for k, w in enumerate(seq)]
        assert [x[i]["perplexity"] for x in found] == pytest.approx([np.exp(-np.mean(logs))] * 3, rel=1e-6), i
    assert [x[5]["threshold"] for x in found] == pytest.approx([found[0][5]["threshold"]] * 3, rel=1e-9)


def test_quality_shuffles_neither_texts_nor_tables_again(spark, monkeypatch):
    """Trusted texts stay where they are, and each round finds the tables dealt by shard; with other languages and repeated or missing ids."""
    r = random.Random(3)
    rows = [(None if i % 50 == 9 else i - i % 20 // 19, r.choice(["en", "en", "de", None]), " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(1, 9)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    labels = spark.createDataFrame([(None if i == 9 else i, 1) for i in range(0, 600, 2)], "doc_id long, quality int")
    plans, real = {}, quality.materialize

    def kept(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(quality, "materialize", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = [sorted((str(x[:3]), x["kept"], round(x["perplexity"], 9), round(x["threshold"], 9)) for x in quality.quality(docs, labels, round_rows=300, **more).collect()) for more in ({}, {"most_ids": 0})]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found[0]) == 600 and found[0] == found[1]
    few, many = plans["training"]
    assert "hashpartitioning(doc_id" not in few and "hashpartitioning(doc_id" in many
    assert len(plans["scored"]) == 4
    for plan in plans["scored"][:2]:
        assert plan.count("Exchange hashpartitioning(shard") == 1  # of what is asked
        assert "Join" not in plan


def test_quality_finds_ngrams_by_their_keys():
    """Hot n-grams are found, filters lose none, and a trigram is in the shard of its last two words, also where thousands share these."""
    r = np.random.default_rng(4)
    u, v, w = r.integers(0, 5_000, 20_000), r.integers(0, 3, 20_000), r.integers(0, 3, 20_000)
    salt = quality.salt_of("en")
    keys, tail = np.unique(quality.triple_keys(u, v, w, salt)), quality.pair_keys(v, w, salt)
    assert len(keys) == len(set(zip(u.tolist(), v.tolist(), w.tolist(), strict=True)))
    for shards in (1, 8, 601):
        assert (quality.shards_of(quality.triple_keys(u, v, w, salt), shards) == quality.shards_of(tail, shards)).all()
        filters = np.zeros(shards * 1_024, np.uint8)
        for k, own in quality.parts_of(keys, shards):
            filters[k * 1_024 : (k + 1) * 1_024] = np.frombuffer(quality.filter_of(keys[own], 8_192), np.uint8)
        assert quality.passed(filters, keys, shards).all() and quality.passed(filters, quality.pair_keys(u + 9, v, salt), shards).mean() < 1
    for n in (0, 1, 7_000):
        own = keys[::2][:n]
        hot = quality.Frequent(np.sort(quality.Frequent.turned(own)), np.zeros(len(own)), np.zeros(len(own)))
        place, there = hot.found(keys)
        assert (there == np.isin(keys, own)).all() and (hot.keys[place[there]] == hot.turned(keys[there])).all()
    words = [b"aab", b"Ab..--x", b"1000", b"====", b"\xc3\xa9t\xc3\xa9"]
    assert quality.shapes(words) == [quality.shape(x) for x in words] == [b"a", b"Aa..--a", b"0", b"==", b"a"]


def brute_secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return secrets.digest(sorted(spans))


def test_secrets(spark, odd, empty):
    extra = ["AKIAAKIA" + "A" * 12, "toKen:'abcdefghijkl' secret = short password='x' API_KEY=" + "k" * 12, "ſecret = abcdefghijklmnop", "a" * 16 + "é" + "0" * 15 + "g" + "0" * 16, "my password is Qx7zP0lmW93kfTTa8, bearer token default_placeholder_example_value1"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).union(spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    true = sorted((str(d), hashlib.sha256(brute_secrets(t).encode()).hexdigest()) for d, t in pairs(docs))
    got = secrets.scan(docs).collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == true
    last = next(r for r in got if r["doc_id"] == 90_004)
    assert last["spans"] == "novel:15:32"
    assert secrets.redact(docs.where("doc_id = 90004")).first()["text"].startswith("my password is [NOVEL], bearer token default")
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == odd.count()
    assert secrets.scan(empty).count() == 0


def brute_contamination(docs, items, n=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    fold = lambda t: re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = fold(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size and i is not None else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, found = fold(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("shingle", [3, 1])
def test_contamination(spark, odd, empty, shingle):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    more = [(900, "One, TWO!"), (901, None), (902, "--"), (None, "one two"), (900, "one two"), (903, " ".join(["the"] * 12)), (904, "é ü é ü é ü é ü é ü é")]
    items = bench.union(spark.createDataFrame(more, "item_id long, text string"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).union(spark.createDataFrame([(70_000, "the " * 30), (70_001, "a one-two b")], "doc_id long, text string"))
    got = decontam.contamination(docs, items, shingle=shingle).drop("items").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_contamination(pairs(docs), [tuple(r) for r in items.collect()])
    assert any(r["contaminated"] for r in got)
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(odd, bench.where("false")).where("contaminated").count() == 0


def test_mixing(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    target = {f"src{k}": 1.0 + k for k in range(20)}
    rows = mixing.mix(docs, target, block=4, bucket_rows=100).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in docs.collect())
    order = sorted({(r["mix_slot"], r["source"], r["mix_block"]) for r in rows})
    assert [s for s, _, _ in order] == list(range(len(order)))
    blocks = {}
    for _, s, b in order:
        assert b == blocks.get(s, 0)
        blocks[s] = b + 1
    end = next(k for k, (_, s, b) in enumerate(order) if b + 1 == blocks[s])  # the first source is through
    total, placed = sum(target.values()), dict.fromkeys(target, 0)
    quota = mixing.shares(target, 4096)
    for k, (_, s, _) in enumerate(order[: end + 1], 1):
        placed[s] += 1
        assert all(abs(placed[x] - k * quota[x] / 4096) < 1 for x in target)
    assert total == 210
    assert len({r["mix_position"] for r in rows}) == len(rows)
    again = {(r["doc_id"], r["mix_position"]) for r in mixing.mix(docs.repartition(7), target, block=4, bucket_rows=100).collect()}
    assert again == {(r["doc_id"], r["mix_position"]) for r in rows}
    strange = mixing.mix(odd.withColumn("mix_slot", F.lit("x")))
    assert strange.count() == odd.count() and strange.columns[-4:] == mixing.NEW
    assert mixing.mix(empty).count() == 0
    assert sum(mixing.shares({"a": 1, "b": 1e9, "c": 3}, 16).values()) == 16


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(5000, "u", None), (5001, None, ""), (5002, "http://x/é\r\nA: b", "dup"), (5003, "u", "dup"), (5003, "u", "dup"), (None, "u", "dup"), (5004, "u", "é" * 300_000)], "page_id long, url string, html string")
    rows = pages.union(odd).withColumn("sha", F.lit(1)).withColumn("role", F.lit("x"))
    uri = warc.write(rows, roll_bytes=20_000, parts=3)
    got = warc.read(spark, uri).collect()
    assert len(got) == rows.count()
    largest = {}
    every = [(r["page_id"], (r["html"] or "").encode()) for r in rows.collect()]
    for p, x in every:
        if p is not None:
            largest[x] = max(p, largest.get(x, p))
    true = sorted((str(p), len(x), warc.base32(hashlib.sha1(x).hexdigest()), "response" if p is None or p == largest[x] else "revisit", str(None if p is None or p == largest[x] else largest[x])) for p, x in every)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == true
    texts = {p: x for p, x in every}
    assert all(bytes(r["payload"]) == texts[r["page_id"]] for r in got if r["record_type"] == "response")
    files, folder = warc.store(uri)
    manifest = files.open_input_stream(f"{folder}/manifest.jsonl").read()
    other = warc.write(rows.repartition(5), roll_bytes=20_000, parts=3)
    again = warc.store(other)[0].open_input_stream(f"{warc.store(other)[1]}/manifest.jsonl").read()
    assert len(manifest.splitlines()) > 3
    assert sum(b'"records"' in x for x in again.splitlines()) >= 3
    assert warc.read(spark, warc.write(rows.where("false"))).count() == 0


def test_licenses(spark, odd, empty):
    mit = licenses.TEMPLATES[4][1]
    texts = ["x y z. Released under the MIT License. more. Licensed under CC BY-NC 4.0.", "é " + mit.replace("Software", "SOFTWARE").replace("free of charge", "at no charge") + " end", "the license of a work under the sea", "Released under the MIT License.\nReleased under the MIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[0]["spans"] == "MIT:7:37,CC-BY-NC-4.0:45:72"
    assert got[1]["licenses"] == "MIT" and got[1]["found"][0]["start"] == 2 and got[1]["found"][0]["coverage"] > 0.95
    assert got[2]["n_matches"] == 0 and got[3]["n_matches"] == 2
    lines = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {r[0] for r in lines.where("text rlike 'Released under the MIT License|licensed under the GNU General Public License, version 3|Licensed under CC BY-NC 4.0|Licensed under the Apache License, Version 2.0'").select("doc_id").collect()}
    assert {r[0] for r in licenses.scan(lines).where("n_matches > 0").select("doc_id").collect()} == planted
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0
    assert licenses.scan(odd, templates=[]).where("n_matches > 0").count() == 0


def brute_licenses(templates, words, coverage=0.85):
    """All alignments by plain recursion over whole neighbourhoods of exact 3-grams, without winnowing or an index."""
    found = set()
    for t, own in enumerate(templates):
        band = min(16, 2 + len(own) // 4)
        places = {tuple(own[i : i + 3]): i for i in range(len(own) - 2)}
        for at in range(len(words) - 2):
            i = places.get(tuple(words[at : at + 3]))
            if i is None:
                continue
            best: dict = {}
            for a in range(len(own) - 1, -1, -1):
                for j in range(2 * band, -1, -1):
                    b = a + at - i + j - band
                    skip = best.get((a, j + 1), []), best.get((a + 1, j - 1), [])
                    longest = max(skip, key=len)
                    if 0 <= b < len(words) and own[a] == words[b] and len(best.get((a + 1, j), [])) + 1 >= len(longest):
                        longest = [b, *best.get((a + 1, j), [])]
                    best[a, j] = longest
            if len(best[0, 0]) >= coverage * len(own):
                found.add((t, len(best[0, 0])))
    return found


def test_licenses_brute_force():
    """Edited templates among other words: the best match of each template is as good as without an index."""
    r = random.Random(9)
    texts = [words(r, n).split() for n in (8, 14, 30)]
    index = licenses.build([(str(k), " ".join(t)) for k, t in enumerate(texts)], 3, 3)
    for turn in range(40):
        own = list(texts[turn % 3])
        for _ in range(turn % 4):
            at = r.randrange(len(own))
            own[at : at + 1] = r.choice([[], ["new"], [own[at], "more"]])
        doc = words(r, 20).split() + own + words(r, 15).split()
        hashed = licenses.WordHash().of([w.encode() for w in doc])
        got = {(t, n) for t, _, _, n in licenses.matches(index, hashed, 3, 3, 16, 0.85)}
        want: dict = {}
        for t, n in brute_licenses(texts, doc):
            want[t] = max(n, want.get(t, 0))
        runs = [k for k, (a, b) in enumerate(zip(own, texts[turn % 3], strict=False)) if a != b]
        if not runs or runs[0] >= 5:  # five words in a row surely share a fingerprint
            assert got == set(want.items()), turn
    many = [(-5, 0, 0, k * 10, k * 10 + 5) for k in range(20_000)]
    assert len(licenses.chosen(many)) == 20_000
    assert licenses.chosen([(-9, 0, 1, 5, 20), (-8, 0, 0, 0, 5), (-7, 0, 2, 21, 25), (-6, 0, 3, 20, 22)]) == [(1, 5, 20, 9), (2, 21, 25, 7)]


def brute_pii(text):
    text = text or ""
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(d):
        return sum(x if j % 2 == 0 else x * 2 - 9 * (x > 4) for j, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_pii_held_out(spark):
    """Recall and precision of the added spans on sentences that no generator made."""
    good = [
        "You can reach Anna at anna.k (at) posteo [dot] de for details.", "mail: bob_77(at)uni-koeln.de", "Please write to j.smith [at] example.org before Friday", "contact sales{at}acme{dot}com", "his address is lee (at) mail (dot) net, I think",
        "Call 415-555-0132 after six.", "my mobile is (212) 555-0199", "Telefon 303.555.0147, bitte", "fax 646 555 0176 or by post", "ring me on 718-555-0101!",
        "SSN 219-09-9999 on file", "her social security number, 078-05-1120, leaked", "tax id: 457-55-5462", "social: 123-45-6789.",
        "IBAN DE89 3704 0044 0532 0130 00", "transfer it to GB29 NWBK 6016 1331 9268 19 today", "Konto: FR1420041010050500013M02606", "pay into NL91ABNA0417164300 please", "cuenta ES91 2100 0418 4502 0005 1332",
    ]
    bad = [
        "tune(at)440.0", "version 000-12-3456", "part 987-65-4321 of the set", "order 666-12-1234", "model 123-00-4567", "serial 100-200-3000", "ratio 001-200-3000 at best", "ISBN 012 345 6789 in print", "build 045.123.4567", "ticket 199-321-0000",
        "code AB12 CDEF GH01 2345 6789", "sku XZ99ABCD01234567", "ref. DE00 1111 2222 3333 4444 55", "lot EF45 0000 1111 2222 3333",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.scan(rows).collect()}
    recall = sum(bool(got[i]) for i in range(len(good))) / len(good)
    wrong = sum(bool(got[len(good) + i]) for i in range(len(bad))) / len(bad)
    assert recall >= 0.85 and wrong <= 0.15, (recall, wrong, [good[i] for i in range(len(good)) if not got[i]], [bad[i] for i in range(len(bad)) if got[len(good) + i]])


def test_pii_of_many_spans(spark):
    """Thousands of spans in one text, base and added, at their places."""
    text = " ".join(f"u{k}@ex.org call ({200 + k % 700}) 555-{k % 10000:04d}" for k in range(3_000))
    row = pii.scan(spark.createDataFrame([(1, text, 2, "x", None)], "doc_id long, text string, b int, found string, m string")).first()
    assert row["n_email"] == 3_000
    base = {f"email:{m.start()}:{m.end()}" for m in re.finditer(r"u[0-9]+@ex\.org", text)}
    assert base <= set(row["spans"].split(",")) and len(row["spans"].split(",")) == 6_000
    assert all(text[x["start"] : x["end"]][0] in "u(" for x in row["found"])


def test_pii(spark, odd, empty):
    texts = [
        "a@b.c_d@e.f x@y z@w.org. é😀 q.r+s@m-n.co.uk", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 +49 (30) 1234-5678 and +1", "@@@ " + "a" * 30_000 + " " + "a." * 5_000 + "@", "+" + "1 " * 5_000,
        "4" * 16 + " " + "4 4" * 3_000, "call (499) 555-6503 or write jo.doe (at) mail [dot] org", "+1 (499) 555-6503.%%%", "12 " * 4_000, "ssn 123-45-6789", "© \\ ' \" + 12345678", "iban DE44 5001 0517 5407 3249 31",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).union(spark.createDataFrame([(80_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    true = []
    for d, t in pairs(docs):
        b = brute_pii(t)
        true.append((str(d), *(sum(k == j for _, k, _ in b) for j in range(4)), hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest()))
    rows = pii.scan(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == sorted(true)
    by = {r["doc_id"]: r for r in rows}
    assert by[80_006]["spans"] == "phone:5:19,email:29:55"
    assert by[80_009]["spans"] == "ssn:4:15" and by[80_011]["spans"].startswith("iban:5:")
    for d, t in pairs(docs):
        base = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_pii(t)]
        assert d is None or d < 10_000 or set(base) <= set(by[d]["spans"].split(","))
    assert pii.scan(empty).count() == 0
