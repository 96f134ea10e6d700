"""The corpus operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratadoc.llm import ctw, decontaminate, exact_dedup, graph, mixing, quality, queries, simhash, suffix_dedup, token_counts, toxicity, url_rules
from stratadoc.llm.fuse_filter import FuseFilter
from stratadoc.llm.suffix_array import suffix_array
from tests.compare import oracle_rows, rows_of, tables

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n ", "one", "one", "a b c d e f g h i j k l", "Ünï çødé " * 20, "long word " * 30_000, "x" * 5000, "<|endoftext|> tail"]
#: Columns whose names the operators use inside.
CLASH = "doc_id long, text string, source string, size long, key string, at long, block long, digest string, fp long, n long"


def odd_docs(spark, texts=ODD):
    return spark.createDataFrame([(i, t, None if i % 3 == 0 else f"s{i % 2}", 1, "k", 2, 3, "d", 4, 5) for i, t in enumerate(texts)], CLASH)


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, label int")
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "long word"), (3, None), (4, ""), (2, "long word")], "item_id int, text string")
    return {
        "quality": lambda d: quality.score(d, quality.train(d, labels.withColumnRenamed("label", "grade"), 2)),
        "exact": lambda d: exact_dedup.exact_groups(d, F.col("doc_id") % 2 == 0),
        "simhash": simhash.near_duplicates,
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels, F.lit(False))),
        "ctw": lambda d: ctw.score(d, F.col("doc_id") == 1),
        "suffix": suffix_dedup.repeated_spans,
        "mixing": mixing.mix,
        "decontaminate": lambda d: decontaminate.contaminated(d, items),
        "tokens": lambda d: token_counts.token_counts(d, queries.vocabulary()),
    }


NAMES = ["quality", "exact", "simhash", "toxicity", "ctw", "suffix", "mixing", "decontaminate", "tokens"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_and_empty_tables(spark, name):
    op, d = operators(spark)[name], odd_docs(spark)
    assert sorted(r.doc_id for r in op(d).collect()) == list(range(len(ODD)))
    assert op(d.limit(0)).collect() == []
    twice = [r.doc_id for r in op(d.unionByName(d)).collect()]
    assert sorted(twice) == sorted([*range(len(ODD))] * 2)


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == oracle_rows(con, queries.ORACLE[name])


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("select doc_id, text from documents").fetchall())


def test_quality_on_rows_that_are_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grades = quality.label_grades(spark.read.parquet(f"{sf}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.train(docs, grades.where(~held), 3)
    assert model.cuts[0] < model.cuts[1]
    got = quality.score(docs, model).join(grades.where(held), "doc_id").collect()
    low = [r.accepted for r in got if r.grade == 0]
    good = [r.accepted for r in got if r.grade > 0]
    assert len(low) > 5 and sum(low) / len(low) < 0.15 and sum(good) / len(good) > 0.95
    clean, toxic = ([r.expected_grade for r in got if r.grade == g] for g in (2, 1))
    assert sum(clean) / len(clean) > sum(toxic) / len(toxic)


def test_quality_query_equals_a_plain_scorer(spark, con, docs):
    """Grams counted in dictionaries, the fitted weights looked up one by one."""
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), quality.label_grades(spark.read.parquet(f"{SF}/labels.parquet")), 3)
    mask, shape = (1 << 64) - 1, [int(x) for x in quality._SHAPE]
    slot = lambda g: (g * 0x9E3779B97F4A7C15 & mask) >> 64 - model.bits

    def tails(text):
        b = text.encode()
        n = max(0, len(b) - 3)
        grams = Counter(slot(int.from_bytes(b[i : i + 4], "big")) + (1 << model.bits) for i in range(n))
        grams += Counter(slot(shape[b[i]] << 16 | shape[b[i + 1]] << 8 | shape[b[i + 2]]) for i in range(n))
        f = sum(math.sqrt(c / n) * float(model.weights[s]) for s, c in grams.items())
        return [1 / (1 + math.exp(-max(-30, min(30, f - c)))) for c in model.cuts]

    for r in queries.op1(spark, SF).collect():
        want = tails(docs[r.doc_id])
        assert (r.expected_grade, r.tail) == pytest.approx((sum(want), want[0]), abs=1e-3) and r.accepted == (r.tail >= 0.5)


def test_quality_takes_the_lower_of_two_grades(spark):
    d = spark.createDataFrame([(1, "good words here"), (2, "zzzz qqqq"), (1, "other words")], "doc_id long, text string")
    rate = lambda rows: quality.train(d, spark.createDataFrame(rows, "doc_id long, grade int"), 2)
    a, b = rate([(1, 1), (2, 0), (2, 1)]), rate([(2, 0), (1, 1)])
    assert (a.weights == b.weights).all() and (a.cuts == b.cuts).all()


def test_ordinal_fit_finds_ordered_cuts():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    f = x @ np.array([2, -1, 0.5, 0, 0], np.float32)
    y = (rng.logistic(size=3000) + f > -1).astype(int) + (rng.logistic(size=3000) + f > 4)
    m = quality.fit(x, np.clip(y, 0, 2), 3, 12)
    t = m.tails(x)
    assert m.cuts[0] < m.cuts[1] and (t[:, 0] >= t[:, 1]).all() and np.corrcoef(t.sum(1), y)[0, 1] > 0.6


@pytest.mark.parametrize("most_broadcast", [1000, 0])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_with_hot_and_clashing_digests(spark, most_broadcast, weak):
    rng = random.Random(5)
    rows = [(i, "copy" if i % 3 == 0 else "pair" if i % 50 == 1 else rng.choice(["", None]) if i % 50 == 2 else f"text {i} {'x' * (i % 4)}") for i in range(400)]
    rows += [(3, "copy"), (401, "text 4 "), (None, "text 5 x"), (None, "lone")]
    digest = (lambda t: F.lpad(F.hex(F.length(t)), 2, "0")) if weak else (lambda t: F.sha2(t, 256))
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), F.col("doc_id") % 2 == 0, 100, most_broadcast, digest).collect()
    of = {}
    for i, t in rows:
        of.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in x if i is not None), default=None) for t, x in of.items()}
    want = sorted((str(i), str(keep[t or ""] if keep[t or ""] is not None else i), len(of[t or ""]), keep[t or ""] == i) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == want


def test_fuse_filters_hold_their_keys():
    for n in (0, 1, 2, 10, 5000):
        keys = np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64)
        f = FuseFilter.build(np.unique(keys))
        assert f.has(keys).all()
        assert f.has(np.random.default_rng(99).integers(0, 1 << 63, 20_000, np.uint64)).mean() < 0.02


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if near(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, docs):
    fp = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = brute_components(sorted(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    got = queries.op3(spark, SF).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fp


@pytest.mark.parametrize("distance, most_bucket", [(3, 256), (3, 2), (2, 2), (1, 2), (0, 2)])
def test_links_join_all_close_fingerprints(spark, distance, most_bucket):
    rng = random.Random(distance)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = set()
    for s in seeds:
        for _ in range(30):
            s ^= 1 << rng.randrange(64) if rng.random() < 0.9 else rng.getrandbits(64)
            fps.add(s)
    fps = sorted(int(np.uint64(x).astype(np.int64)) for x in fps)
    mask = (1 << 64) - 1
    want = brute_components(fps, lambda a, b: ((a ^ b) & mask).bit_count() <= distance)
    e = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), distance, 6, most_bucket)
    got = {r.node: r.root for r in graph.components(e).collect()}
    assert {x: got.get(x, x) for x in fps} == want


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.components(e).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def plain_neighbours(e, words):
    """A function to scores and similarities by the book: every example's whole vector against the text's, in dictionaries."""
    many, many1 = len(words), sum(y for _, y in words.values())
    of = words
    n, n1 = Counter(t for c, _ in of.values() for t in c), Counter(t for c, y in of.values() if y for t in c)

    def weight(t):
        p1, p0, p = (n1[t] + 0.5) / (many1 + 1), (n[t] - n1[t] + 0.5) / (many - many1 + 1), (n[t] + 1) / (many + 2)
        z = (p1 - p0) / math.sqrt(p * (1 - p) * (1 / many1 + 1 / (many - many1)))
        return (math.log((1 + many) / (1 + n[t])) + 1) * (1 + abs(math.log(p1 / p0)) * max(abs(z) - 2, 0))

    w = {t: weight(t) for t in n}

    def unit(c):
        v = {t: (1 + math.log(x)) * w[t] for t, x in c.items() if t in w}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    units = {i: unit(c) for i, (c, _) in of.items()}

    def search(found):
        q = unit(found)
        near = sorted(((sum(x * u.get(t, 0) for t, x in q.items()), i) for i, u in units.items()), reverse=True)
        near = [(s, i) for s, i in near if s > 0][: e.k]
        vote = (sum(s * of[i][1] for s, i in near) + e.shrink * e.prior) / (sum(s for s, _ in near) + e.shrink)
        return (float(np.interp(vote, *e.steps)) if near else e.prior), [s for s, _ in near]

    return search


def test_toxicity_equals_every_pair(spark, con, docs):
    mark = {i: y for i, y in con.execute("select doc_id, toxic from labels").fetchall() if zlib.crc32(str(i).encode()) % 4 != 2}
    words = {i: (toxicity.doc_terms(docs[i]), y) for i, y in mark.items()}
    labels = spark.createDataFrame(list(mark.items()), "doc_id long, label int")
    e = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels, F.lit(False))
    assert len(e.ids) == len(mark) and len(e.steps[0]) > 2
    got = {r.doc_id: r for r in queries.op4(spark, SF).collect()}
    search = plain_neighbours(e, words)
    for i, t in docs.items():
        want, similar = search(toxicity.doc_terms(t))
        assert got[i].score == pytest.approx(want, abs=1e-4), i
        assert [x.similarity for x in got[i].evidence] == pytest.approx(similar[:3], abs=1e-5)


def test_blocks_that_cannot_hold_a_neighbour_are_all_that_is_left_out():
    rng = np.random.default_rng(2)
    words = [f"{a}{b}{c}" for a in "abcde" for b in "fghij" for c in "klmno"]
    make = lambda: Counter(words[i] for i in (rng.zipf(1.3, 12) + rng.integers(0, 9)) % len(words))
    texts = [make() for _ in range(700)]
    e = toxicity.Examples(list(range(700)), texts, rng.integers(0, 2, 700), k=7)
    dense = np.zeros((700, len(e.term)))
    for i, c in enumerate(texts):
        at, v = e.vector(" ".join(c.elements()))
        dense[e.place[i], at] = v
    for _ in range(200):
        c = make()
        at, v = e.vector(" ".join(c.elements()))
        near, similarity = e.nearest(at, v)
        q = np.zeros(len(e.term))
        q[at] = v
        want = dense @ q
        assert np.allclose(np.sort(want)[::-1][: len(similarity)], similarity, atol=1e-5) and np.allclose(want[near], similarity, atol=1e-5)
        assert len(similarity) == min(7, (want > 0).sum())


def test_toxicity_on_held_out_rows(spark, con):
    sf = "/root/testdata/sf0.01"
    mark = dict(tables(sf).execute("select doc_id, toxic from labels").fetchall())
    rows = queries.op4(spark, sf).select("doc_id", "held_out", "score", "predicted").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    got = [(r.score, r.predicted, mark[r.doc_id]) for r in rows if r.held_out and r.doc_id in mark]
    assert sum(p == y for _, p, y in got) / len(got) > 0.85
    pairs = [(a > b) + (a == b) / 2 for a, _, x in got if x for b, _, y in got if not y]
    assert sum(pairs) / len(pairs) > 0.9


def test_toxicity_takes_conflicting_labels_as_toxic(spark):
    d = spark.createDataFrame([(1, "vile muck"), (2, "kind words"), (3, "vile")], "doc_id long, text string")
    label = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (9, 1), (2, 7)], "doc_id long, label int")
    e = toxicity.train(d, label, F.lit(False))
    assert sorted(zip(e.ids, e.labels.tolist(), strict=True)) == [(1, 1.0), (2, 0.0)]


def plain_ctw(train, text):
    """The same mixture by the book, one bit at a time, on tables of counts."""
    count = {}
    pad = bytes([255]) * ctw.DEPTH

    def walk(raw):
        b = pad + raw + b"\xff"
        for i in range(ctw.DEPTH, len(b)):
            for j in range(8):
                q = 1 << j | b[i] >> 8 - j
                yield [(b[i - d : i], q) for d in range(ctw.DEPTH + 1)], b[i] >> 7 - j & 1

    children = {}
    for raw in train:
        for path, bit in walk(raw):
            for d, node in enumerate(path):
                count.setdefault(node, [0, 0])[bit] += 1
                if d:
                    children.setdefault(path[d - 1], set()).add(node)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted = {}

    def pw(node):
        if node not in weighted:
            own = kt(*count[node])
            weighted[node] = own if len(node[0]) == ctw.DEPTH else np.logaddexp(own, sum(map(pw, children[node]))) - math.log(2)
        return weighted[node]

    total = 0.0
    for path, bit in walk(text):
        p, rest = 0.0, 1.0
        known = [n for n in path if n in count]
        for n in known:
            a, b = count[n]
            one = (b + 0.5) / (a + b + 1)
            share = 1.0 if len(n[0]) == ctw.DEPTH else math.exp(kt(a, b) - math.log(2) - pw(n))
            p, rest = p + rest * share * one, rest * (1 - share)
        p += rest / 2  # contexts not seen
        total += math.log10(p if bit else 1 - p)
    return total


def test_context_trees_equal_the_definition(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cdé") for _ in range(rng.randrange(60))) for _ in range(12)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score(d, F.col("doc_id") % 3 == 0, block_bytes=100).collect()}
    train = [t.encode() for i, t in enumerate(texts) if i % 3]
    for i, t in enumerate(texts):
        want = plain_ctw(train, t.encode())
        assert got[i].score == pytest.approx(want, abs=1e-6), i
        assert got[i].bits_per_byte == pytest.approx(-want * math.log2(10) / (len(t.encode()) + 1), abs=1e-6)


def test_the_sixth_byte_before_counts(spark):
    d = spark.createDataFrame([(i, f"{i % 2}abcde{i % 2}") for i in range(40)] + [(40, "0abcde0"), (41, "0abcde1")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ctw.score(d, F.col("doc_id") >= 40).collect()}
    assert got[40] > got[41] + 1


def test_packed_grams_come_back():
    rng = np.random.default_rng(3)
    gram = np.unique(rng.integers(0, 1 << 56, 5000, dtype=np.uint64))
    assert (ctw._unpack(ctw._pack(gram)) == gram).all()
    order, start = ctw._classed(gram, 7)
    assert sorted(order) == list(range(len(gram))) and start[-1] == len(gram)
    value = rng.random(len(gram))
    assert (ctw._numbers(ctw._planes(value), np.float64) == value).all()
    assert (ctw.Slots(gram[order], value[order]).of(gram) == value).all()
    with pytest.raises(KeyError):
        ctw.Slots(gram, value).of(gram[:9] + np.uint64(1))


def test_base_score_equals_the_formula(spark, docs):
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None]
    count = {}
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for w in words(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for r in queries.op5(spark, SF).collect():
        w = words(docs[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w))


@pytest.mark.parametrize("url", [None, "", "x", "http://", "://com/", "http://EXAMPLE.com/en/x?y#z", "https://a.www.example.com/en/", "http://evil.com,foo/en/", "http://net/es/1", "http://x.net?/es/", "http://com", "http://notexample.com/en/", "http://example.com./en/"])
def test_url_rules_equal_a_loop(spark, url):
    got = url_rules.apply_rules(spark.createDataFrame([(1, url)], "page_id int, url string"), queries.rules(spark), slices=3).first()
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().lower()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fit = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    assert (got.host, got.path, got.rule, got.verdict) == (host, path, best[1], best[2])


def test_url_rules_on_random_hosts(spark):
    rng = random.Random(8)
    host = lambda: ".".join(rng.choice(["a", "b", "c0", "c"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(3)))
    rules = list({(host(), path(), rng.choice(["allow", "block"])) for _ in range(40)})
    urls = [(i, f"http://{host()}{path()}") for i in range(300)]
    d = url_rules.apply_rules(spark.createDataFrame(urls, "page_id int, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    for r in d.collect():
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        want = max(fit, default=None)
        assert (r.rule, r.verdict) == ((want[2], max(f[3] for f in fit if f[:3] == want[:3])) if want else (None, "allow"))


def test_url_rules_on_odd_tables(spark):
    clash = "page_id long, url string, key string, at string, rule string, salt int, own boolean, n int, html string"
    urls = [None, "", "x", "http://", "http://a.b/p/q", "http://a.b/p/q", "http://.b/", "http://b./p", "http://a..b/p􏿿", "http://b/" + "p/" * 3000, "http://b/p\x00", "HTTP://A.B/P"]
    rows = [(i // 2 if i < 10 else None, u, "k", "a", "r", 1, True, 1, "h") for i, u in enumerate(urls)]
    rule = [("b", None, "allow"), ("B", "/p", "block"), ("b", "/p", "allow"), ("a.b", "/p/q", "allow"), ("b", "/p/", "allow"), (None, "/", "block"), ("", "/", "block"), ("b", "/x", None), ("b", "/p􏿿", "allow")]
    rules = [("b", "", "allow"), ("b", "/p", "block"), ("a.b", "/p/q", "allow"), ("b", "/p/", "allow"), ("b", "/p􏿿", "allow")]
    pages, table = spark.createDataFrame(rows, clash), spark.createDataFrame(rule, "host string, path string, verdict string")

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group().lower()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fit, default=(0, 0, None, "allow"))[2:])

    for most in (100, 0):
        for d in (pages, pages.unionByName(pages)):
            got = url_rules.apply_rules(d, table, slices=5, most_broadcast=most).collect()
            assert sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(repr((r.page_id, *want(r.url))) for r in d.collect())
    assert url_rules.apply_rules(pages.limit(0), table).collect() == []
    assert {(r.rule, r.verdict) for r in url_rules.apply_rules(pages, table.limit(0), "block").collect()} == {(None, "block")}


def brute_spans(docs, length=100):
    seen, out = set(), {}
    for i in sorted(docs):
        b = docs[i].encode()
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                hit[s : s + length] = True
            else:
                seen.add(b[s : s + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        out[i] = (len(b), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def spans_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_repeated_spans_equal_brute_force(spark, docs):
    assert spans_of(queries.op7(spark, SF)) == brute_spans(docs)


def test_repeated_spans_of_made_up_texts(spark):
    rng = random.Random(9)
    piece = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(30, 260))) for _ in range(12)]
    docs = {i: "".join(rng.choice(piece)[rng.randrange(20) :] for _ in range(rng.randrange(6))) for i in range(60)}
    docs |= {100: "ab" * 300, 101: "ab" * 90, 102: "z" * 99, 103: "z" * 100, 104: "z" * 101}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert spans_of(suffix_dedup.repeated_spans(d, shard_bytes=3000)) == brute_spans(docs)


def test_a_line_in_many_surroundings_is_split(spark, monkeypatch):
    rng = random.Random(12)
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    line, ends = made("abcdefgh", 130), [made("xyz ", 90) for _ in range(12)]
    docs = {i: rng.choice(ends) + made("uv", rng.randrange(9)) + line + made("uv", rng.randrange(9)) + rng.choice(ends)[rng.randrange(60) :] for i in range(300)}
    docs |= {i: line[: rng.randrange(130)] + line[rng.randrange(130) :] for i in range(300, 400)}
    real = suffix_dedup._sort_shards

    def watched(length, shard_bytes):
        sort = real(length, shard_bytes)

        def run(batches):
            def seen():
                size = {}
                for b in batches:
                    for k, x in zip(b.column("key").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                        size[k] = size.get(k, 0) + len(x)
                    assert max(size.values(), default=0) <= 2 * shard_bytes
                    yield b

            return sort(seen())

        return run

    monkeypatch.setattr(suffix_dedup, "_sort_shards", watched)
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert spans_of(suffix_dedup.repeated_spans(d, shard_bytes=500)) == brute_spans(docs)


def anchor_rows(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    out = suffix_dedup._find(100)(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts)], ["doc_id", "text"])]))
    return sorted(map(repr, pa.Table.from_batches(out).to_pylist()))


def test_anchors_do_not_depend_on_how_texts_are_cut(monkeypatch):
    rng = random.Random(4)
    part = ["".join(rng.choice("abcé ") for _ in range(300)) for _ in range(9)]
    texts = ["".join(rng.choice(part)[rng.randrange(99) :] for _ in range(n)) for n in (0, 1, 2, 9, 40, 3)] + ["ab" * 900, "z" * 100, "z" * 99, "y" * 401]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (399, 400, 401, 500, 800, 1201)]
    whole = anchor_rows(texts)
    monkeypatch.setattr(suffix_dedup, "_BUFFER", 64)
    assert anchor_rows(texts) == whole


def test_suffix_dedup_holds_little_at_a_time():
    rng = np.random.default_rng(6)
    word = rng.integers(97, 123, 12 << 20, np.uint8).tobytes().decode()
    texts = [word[: 8 << 20], *(word[i : i + 4000] for i in range(8 << 20, 12 << 20, 4000))]
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([[*range(100, len(t) - 200, 100)] for t in texts])]
    pieces = [texts[0][i : i + 134].encode() for i in range(0, 4 << 20, 134)]
    shard = pa.RecordBatch.from_arrays([pa.array(range(len(pieces))), pa.array(range(len(pieces))), pa.array([0] * len(pieces)), pa.array(pieces)], ["key", "doc_id", "at", "bytes"])
    shard_bytes = suffix_dedup.repeated_spans.__defaults__[1]
    stages = {
        "find": (suffix_dedup._find(100), pa.RecordBatch.from_arrays(columns[:2], ["doc_id", "text"])),
        "halves": (suffix_dedup._halves(100, 32, 34), pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "places"])),
        "sort": (suffix_dedup._sort_shards(100, shard_bytes), shard),
    }
    most = {}
    for name, (stage, batch) in stages.items():
        tracemalloc.start()
        for _ in stage(iter([batch])):
            pass
        most[name] = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
    assert max(most.values()) < 150, most


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randint(1, rng.choice([2, 3, 6])) for _ in range(rng.randint(1, 60))] + [0]
        assert list(suffix_array(np.array(s))) == sorted(range(len(s)), key=lambda i: s[i:])


def test_mix_meets_its_targets(spark):
    d = spark.createDataFrame([(i, "w " * (i % 7), ["a", "a", "a", "b", None][i % 5]) for i in range(500)], "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    for s in ("a", "b", None):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
        assert all(r.taken <= 3 * r.size for r in mine)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))
    assert [r.position for r in got if r.position is not None] == sorted(r.position for r in got if r.position is not None)
    assert got == mixing.mix(d.repartition(3)).collect()


def test_each_pass_has_its_position(spark):
    d = spark.createDataFrame([(i, "w " * (i % 7), "b" if i % 10 == 3 else "a" if i % 10 else None) for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert max(r.taken for r in got if r.source == "b") > 0 and any(len(r.positions) == 3 for r in got)
    slope = {"a": 0.0, "b": 0.5, None: -0.5}
    for s, k in slope.items():
        mine = sorted((r for r in got if r.source == s), key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest())
        goal, before, words = round(mine[0].target), 0, 0
        due = {r.doc_id: [] for r in mine}
        for _ in range(3):
            for r in mine:
                if r.size and before < goal:
                    due[r.doc_id].append(before)
                    words += min(r.size, goal - before)
                before += r.size
        assert words == sum(r.taken for r in mine)
        for r in mine:
            assert [(t + k * (t * t - t)) * r.target for t in r.positions] == pytest.approx(due[r.doc_id], abs=1e-6)
            assert r.position == (r.positions[0] if r.positions else None)


def test_the_mix_follows_its_schedules(spark):
    """Words placed by time t against the schedules added up step by step, and every source present to the end."""
    sf = "/root/testdata/sf0.01"
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    names = sorted({r.source for r in rows})
    longest = max(r.size for r in rows)
    for n, s in enumerate(names):
        mine = [r for r in rows if r.source == s]
        slope, target, size = (0.0, 0.5, -0.5)[n % 3], mine[0].target, mine[0].source_size
        due = sorted((t, r.size) for r in mine for t in r.positions)
        step, asked = 1 / 1000, 0.0
        for k in range(1000):
            asked += target * (1 + slope * (2 * (k + 0.5) * step - 1)) * step
            placed = sum(w for t, w in due if t < (k + 1) * step) if k % 100 == 99 else None
            assert placed is None or abs(placed - asked) <= longest + 1, (s, k)
        assert max(t for t, _ in due) > 1 - 2 * longest / target - 1e-9
        assert all(len(r.positions) <= 3 for r in mine) and size == sum(r.size for r in mine)


def test_every_shared_span_is_found(spark):
    rng = random.Random(11)
    word = lambda: "w" + str(rng.randrange(30))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(12)]
    docs = [(i, " ".join([word() for _ in range(rng.randrange(40))] + (items[i % 12][1].upper().split() if i % 2 else []) + [word() for _ in range(5)])) for i in range(60)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    for r in got.collect():
        w = docs[r.doc_id][1].lower().split()
        hit, found = set(), set()
        for i, t in items:
            t = t.split()
            n = min(10, len(t))
            for s in range(len(t) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == t[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(found))


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary())
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in queries.op10(spark, SF).collect()} == {i: n(t) for i, t in docs.items()}
    c, rng = token_counts.PrefixCounter(queries.vocabulary()), random.Random(1)
    bits = ["a", "the", " ", "  ", "\n", "'s", "'re", "é", "漢字", "😀", "\xa0", "1", "!!", "<|endoftext|>", "ß", " world"]
    for _ in range(400):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(10)))
        table = c.prefix_counts(t)
        assert all(table[len(t[:i].encode())] == n(t[:i]) for i in range(len(t) + 1)), t
        cut = t.encode()[: c.cut(t, 3)].decode()
        assert n(cut) <= 3


def test_pipeline_equals_its_stages_by_brute_force(spark, docs, con):
    import corpus_pipeline as p

    kept = p.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert kept.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
    left = {r.doc_id: r.text for r in kept.collect()}
    best = {}
    for i, t in left.items():
        best[t] = max(i, best.get(t, i))
    left = {i: t for t, i in best.items()}
    fp = {i: brute_fingerprint(t) for i, t in left.items()}
    group = brute_components(sorted(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    left = {i for i in left if group[i] == i}
    leaked = {r[0] for r in con.execute(f"select doc_id from ({queries.ORACLE['op9_decontaminate']}) where contaminated").fetchall()}
    assert {r.doc_id for r in p.run(spark, SF).collect()} == left - leaked


@pytest.fixture
def odd_folder(spark, tmp_path):
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(9)] + [(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None), (3, "")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_tables(spark, odd_folder, stage):
    import corpus_pipeline as p

    name, f = p.STAGES[stage]
    d = odd_docs(spark)
    got = f(spark, d, odd_folder)
    ids = sorted(r.doc_id for r in got.collect())
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    assert f(spark, d.limit(0), odd_folder).collect() == []
    if name != "mix":
        assert got.columns == d.columns
    if name == "exact_dedup":
        best = {t: max(i for i in texts if texts[i] == t) for t in texts.values()}
        assert ids == sorted(best.values())
        none = spark.createDataFrame([(None, "one", None, 1, "k", 2, 3, "d", 4, 5)] * 2 + [(None, "two", None, 1, "k", 2, 3, "d", 4, 5)] * 2 + [(4, "other", None, 1, "k", 2, 3, "d", 4, 5)], d.schema)
        twice = f(spark, d.unionByName(d).unionByName(none), odd_folder).collect()
        assert sorted((str(r.doc_id), r.text or "") for r in twice) == sorted([(str(i), t) for t, i in best.items()] + [("None", "two"), ("4", "other")])
    if name == "near_dedup":
        fp = {i: brute_fingerprint(t) for i, t in texts.items()}
        group = brute_components(sorted(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
        assert ids == [i for i in sorted(fp) if group[i] == i]
    if name == "decontaminate":
        assert ids == [i for i in texts if i != 5]
    if name == "mix":
        assert ids == sorted(texts)
    if name == "quality":
        assert set(ids) <= set(texts)


def test_only_plain_byte_level_vocabularies_are_taken(tmp_path):
    import json

    with open(queries.vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        (tmp_path / "v.json").write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError, match="byte-level"):
            token_counts.PrefixCounter(str(tmp_path / "v.json"))
