import collections
import hashlib
import random

import numpy as np

from pagesift.llm import suffixes as S


def brute(texts, n=200):
    """(n_bytes, n_removed, n_spans, sha256) of each text, from counts of all strings."""
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df, **more):
    return sorted(tuple(r)[1:] for r in S.remove_repeats(df, **more).collect())


def test_documents(documents):
    texts = [r.text for r in documents.collect()]
    assert found(documents) == sorted(brute(texts))


def test_passages_periods_and_copies(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, line = word(350), word(90)
    texts = [word(300) + passage + word(200) for _ in range(30)]
    texts += [word(150) + line + word(150) for _ in range(40)]
    texts += ["x" * 700, "ab" * 400, "x" * 199, word(199), word(200), passage[:200], passage[10:260]]
    texts += [texts[0], texts[0][5:], word(120) + passage[:195] + word(100), None, "", passage + passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(df) == sorted(brute(texts))
    assert found(df, block=4) == sorted(brute(texts))


def test_deep_shallow_classes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    data[2000:2200] = 7
    start, n = np.arange(0, 2900), 60
    group = start % 3
    got = S.deep_shallow(data, start, group, n)
    classes = collections.defaultdict(list)
    for s in start:
        classes[(s % 3, data[s : s + n].tobytes())].append(int(s))
    want = {tuple(v) for v in classes.values() if len(v) > 1}
    mine = collections.defaultdict(list)
    for s, c in zip(start.tolist(), got.tolist(), strict=True):
        if c >= 0:
            mine[c].append(s)
    assert {tuple(v) for v in mine.values()} == want and want


def test_edges(edges, empty):
    texts = [r.text for r in edges.collect()]
    small = edges.where("coalesce(doc_id, 0) <> 5")
    assert found(small) == sorted(brute([t for t in texts if not t or len(t) < 1000]))
    long = [r for r in S.remove_repeats(edges).collect() if r.id == 5][0]
    assert long.n_removed == long.n_bytes and long.n_spans == 1
    assert S.remove_repeats(empty).count() == 0
