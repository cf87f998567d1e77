import random
import re
import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from wavehold.llm.queries import QUERIES
from wavehold.llm.runs import re_pair, repeated_runs, text_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """(start, stop, period) by trying every period over the whole text."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e, q) for (s, e), q in found.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(((s, e - s, q) for s, e, q in plain_runs(w)), key=lambda r: (r[0], r[2]))
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = lambda x: sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_texts(rnd, count):
    for _ in range(count):
        n, kinds = rnd.choice([0, 1, 5, 6, 7, 30, 90]), rnd.choice([1, 2, 3, 9])
        t = [rnd.randrange(kinds) for _ in range(n)]
        if n and rnd.random() < 0.6:
            p, a = rnd.randint(1, 6), rnd.randrange(n)
            t[a : a + p] = t[a : a + p] * rnd.randint(3, 9)
        yield t


def test_runs_of_many_texts_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(250):
        texts = list(random_texts(rnd, rnd.randint(1, 6)))
        got = list(zip(*(x.tolist() for x in text_runs(np.array(sum(texts, []), np.int64), np.cumsum([len(t) for t in texts])))))
        want, off = [], 0
        for t in texts:
            want += [(s + off, e + off, q) for s, e, q in plain_runs(t)]
            off += len(t)
        assert got == sorted(want, key=lambda r: (r[0], r[2]))


def test_grammar_derives_its_texts():
    """Every place of a nonterminal spells the words of its first place, and what is left repeats no pair."""
    rnd = random.Random(6)
    texts = [[rnd.randrange(4) for _ in range(200)] for _ in range(5)] + [[], [1], [2] * 300]
    words, ends = np.array(sum(texts, []), np.int64), np.cumsum([len(t) for t in texts])
    rounds, start, text = re_pair(words, ends)
    used = 0
    for rules in rounds:
        for k, (a, m, b) in enumerate(zip(rules.first, rules.mid, rules.stop)):
            places = rules.starts[rules.at[k] : rules.at[k + 1]]
            assert len(places) > 1 and a < m < b
            for p in places:
                assert words[p : p + b - a].tolist() == words[a:b].tolist()
                assert np.searchsorted(ends, p, side="right") == np.searchsorted(ends, p + b - a - 1, side="right")
            used += len(places)
    assert used + len(start) == len(words)  # each replacement shortens the texts by one symbol
    spans = [tuple(words[a:b]) for a, b in zip(start, np.r_[start[1:], len(words)])]
    pairs = [spans[k] + (None,) + spans[k + 1] for k in range(len(spans) - 1) if text[k] == text[k + 1]]
    assert len(start) < len(words) / 3 and len(pairs) > 0


def test_odd_rows(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    extra = [(k, "a b c " * k) for k in range(60)] + [(1000 + k, "x " * k + "y") for k in range(12)] + [(3, "same words " * 9), (3, "same words " * 9)]
    df = odd.select("doc_id", "text", "start", "a") if "start" in odd.columns else odd.select("doc_id", "text", F.lit("q").alias("period"))
    df = df.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"), allowMissingColumns=True)
    short = [(i, t) for i, t in docs + extra if len(t or "") < 5_000]
    got = repeated_runs(df.where("text IS NULL OR length(text) < 5000"), plant=True, words_at_once=100).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(i, t) for i, t in short), key=str)
    assert repeated_runs(none).count() == 0
    lone = repeated_runs(odd.where("doc_id = 5")).select("n_words", "n_runs").collect()
    assert [tuple(r) for r in lone] == [(30_000, 1)] * 2  # 977 different words, over and over


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[:8] for r in QUERIES["op11_grammar_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    few = [r for r in docs if len(r.text or "") < 12_000]
    assert len(few) > 150 and any(got[r.doc_id][1] for r in few)
    for r in few:
        assert got[r.doc_id] == plain_row(r.doc_id, r.text)
