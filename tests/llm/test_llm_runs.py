"""Runs against a walk over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from pagesift.llm import periodic_runs as R
from pagesift.llm.queries import QUERIES


def brute(words):
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] == words[i + q]:
                j = i
                while j < n - q and words[j] == words[j + q]:
                    j += 1
                s = words[i : j + q]
                if len(s) >= max(6, 4 * q) and not any(
                    all(s[x] == s[x + p] for x in range(len(s) - p)) for p in range(1, q)
                ):
                    out.add((i, len(s), q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, n, q in runs for i in range(start + q, start + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def digest(doc_id, words):
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())


def found(docs):
    runs, left = R._slice(docs)
    return [[(r["start"], r["length"], r["period"]) for r in own] for own in runs], left


def test_random_words_of_several_documents():
    rng = random.Random(5)
    for _ in range(1500):
        docs = []
        for _ in range(rng.randint(1, 5)):
            k, n = rng.choice([1, 2, 2, 3, 10]), rng.choice([0, 1, 5, 6, 20, 60, 150])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.6 and n:
                a = rng.randrange(n)
                p = min(rng.randint(1, max(1, n // 4)), n - a)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
                if rng.random() < 0.5:
                    w[rng.randrange(n)] = 99
            docs.append([b"%d" % x for x in w])
        runs, left = found(docs)
        assert runs == [brute(d) for d in docs]
        assert left == [collapsed(d, r) for d, r in zip(docs, runs, strict=True)]


def test_words_built_to_be_hard():
    fib, other = [b"a"], [b"a", b"b"]
    while len(other) < 1500:
        fib, other = other, other + fib
    thue = [b"ab"[bin(i).count("1") % 2 :][:1] for i in range(1024)]
    nested = ([b"x"] * 9 + [b"y"]) * 12 + [b"z"]
    docs = [other, thue, nested * 5, [b"a"] * 3000, [b"a", b"b"] * 700 + [b"a"] * 5, other + thue + nested]
    runs, _ = found(docs)
    assert runs == [brute(d) for d in docs]


def test_every_word_lies_under_one_root():
    rng = random.Random(3)
    words = np.array([rng.randrange(4) for _ in range(500)])
    docs = np.sort(np.array([rng.randrange(3) for _ in range(500)]))
    symbol, start, middle, end = R.derive(words, docs)
    assert len(symbol) == 500 - 3 and (start < middle).all() and (middle < end).all()
    spelled = {}
    for x, a, m, b in zip(symbol, start, middle, end, strict=True):
        own = (tuple(words[a:m]), tuple(words[m:b]))
        assert spelled.setdefault(x, own) == own and docs[a] == docs[b - 1]


def test_long_document_in_bounded_tests(monkeypatch):
    monkeypatch.setattr(R, "TESTS", 64)
    rng = random.Random(9)
    w = [b"%d" % rng.randrange(3) for _ in range(400)] + [b"p", b"q", b"r"] * 100
    runs, _ = found([w])
    assert runs == [brute(w)]


def test_query(spark, documents):
    got = {tuple(r) for r in QUERIES["op13_grammar_runs"](spark, "/root/testdata/sf0.001").collect()}
    want = {digest(r.doc_id, planted(r.doc_id, r.text)) for r in documents.collect()}
    assert got == want and any(r[1] for r in want)


def test_odd_rows(spark, edges, empty, tmp_path):
    odd = [(i, t) for i, t in enumerate([" \x0b a\x0cb\x0b\ta b a b a b a b ", "　a  b", "w " * 7, "", None]
                                        * 30)] + [(None, "x x x x x x"), (7, "y " * 6)]
    both = spark.createDataFrame(odd, "doc_id long, text string").unionByName(edges.select("doc_id", "text"))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, map(tuple, QUERIES["op13_grammar_runs"](spark, str(tmp_path)).collect())))
    rows = [*odd, *((r.doc_id, r.text) for r in edges.collect())]
    want = []
    for d, t in rows:
        words = planted(d, t)
        if len(words) > 5000:  # the long text repeats four words to its end
            runs = [(0, len(words), 4)]
            assert words == words[:4] * (len(words) // 4)
            lines = f"0,{len(words)},4\n"
            want.append((d, 1, *runs[0], 250 * len(words), hashlib.sha256(lines.encode()).hexdigest(),
                         hashlib.sha256(collapsed(words, runs)).hexdigest()))
        else:
            want.append(digest(d, words))
    assert got == sorted(map(str, want))
    assert R.find_runs(edges).columns == ["id", "n_words", "runs", "collapsed"]
    assert R.find_runs(empty).count() == 0
