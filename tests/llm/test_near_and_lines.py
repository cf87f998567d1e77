import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from wavehold.llm import fuzzy_lines, queries
from wavehold.llm.linking import Judge, components, linked_groups
from wavehold.llm.near_dup import SKETCH_BITS, drop_near_duplicates, near_duplicates, shingle_sets, signatures, sketch_limit


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def edited(words, share, rng):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words]


@pytest.fixture(scope="module")
def copies():
    """Texts around the threshold: families of edits, a crowd of copies, blank and short texts."""
    rng, rows = random.Random(7), []
    for family in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 8)):
            rows.append(" ".join(edited(base, rng.choice([0, 0.003, 0.01, 0.02, 0.03, 0.05]), rng)))
    rows += ["The Crowd of copies is a third of all rows"] * 60 + [None, "", " \n", "one two", "ONE\ttwo", "one two three"]
    rng.shuffle(rows)
    return {k + 1: t for k, t in enumerate(rows)}


@pytest.mark.parametrize("percent,bands,rows", [(85, 21, 6), (80, 32, 5)])
def test_groups_equal_brute_force(spark, copies, near_groups, percent, bands, rows):
    want, sets = near_groups(copies, percent)
    got = near_duplicates(frame(spark, list(copies.items())), percent, bands, rows).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_crowd_of_near_copies(spark, near_groups):
    # edits come from a small stock, so that members share some of them: rare, seldom and common shingles
    rng = random.Random(21)
    base = [f"w{k}" for k in range(140)]
    stock = [(rng.randrange(140), f"s{k}") for k in range(60)]
    rows = {}
    for i in range(1, 321):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            at, word = rng.choice(stock) if rng.random() < 0.6 else (rng.randrange(140), f"own{i}x{rng.randrange(10**6)}")
            words[at] = word
        rows[i] = " ".join(words)
    want, _ = near_groups(rows, 85)
    got = near_duplicates(frame(spark, list(rows.items())))
    assert {r.doc_id: r.component_id for r in got.collect()} == want and len(set(want.values())) > 20


def test_crowd_with_repeated_rows(spark):
    # two of a kind share two rare edits; one band of one row leaves them to meet in the crowd's buckets only
    rng = random.Random(22)
    base, rows = [f"w{k}" for k in range(160)], {}
    for i in range(1, 161):
        words = list(base)
        for at in (i // 2 % 70 + 5, i // 2 % 60 + 90):
            words[at] = f"c{i // 2}x{at}"
        words[rng.randrange(160)] = f"own{i}"
        rows[i] = " ".join(words)
    groups = lambda rows: {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), bands=1, rows=1).collect()}
    want = groups(list(rows.items()))
    twice = [(i, t.upper() if i % 2 else t) for i, t in rows.items() if i % 3 == 0] + [(i, t) for i, t in rows.items() if i % 9 == 0]
    assert groups([*rows.items(), *twice]) == want and 20 < sum(i != c for i, c in want.items()) < 100


def test_odd_rows(spark, odd, none):
    got = {r.doc_id: r for r in near_duplicates(odd).collect() if r.doc_id is not None}
    assert got[2].component_id == 2 and got[3].component_id == 3 and got[4].component_id == 4 and got[3].n_shingles == 0
    assert got[12].component_id == 1 and got[6].component_id == 1 and got[10].component_id == 9 and got[7].component_id == 5
    lonely = [r for r in near_duplicates(odd).collect() if r.doc_id is None]
    assert len(lonely) == 2 and all(r.kept and r.component_id is None for r in lonely)
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "5", "8", "9", "11", "13", "None", "None"])
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_odd_sketches_estimate_and_bound():
    rng = random.Random(3)
    base = [f"w{k}" for k in range(2000)]
    other = edited(base, 0.01, rng)
    sets = shingle_sets([" ".join(base).encode(), " ".join(other).encode()])
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    band, sketch = signatures(sets, 40, 6)
    bits = int(np.unpackbits((sketch[0] ^ sketch[1]).view(np.uint8)).sum())
    differ = -SKETCH_BITS / 4 * np.log(1 - 2 * bits / SKETCH_BITS)
    assert abs((1 - differ / 240) - true) < 0.12
    assert bits <= sketch_limit(true, 240) < SKETCH_BITS / 2
    assert (signatures(sets[:1], 40, 6)[0] == band[:1]).all()


def test_components(spark, union):
    join, find = union
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(1, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    pairs = [(a, b) for a, b in pairs if a != b]
    for a, b in pairs:
        join(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for p in pairs for i in p}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_away_from_the_center_are_found(spark):
    # 2-3 and 4-5 are links, none of them with 1, which is the least id of their only bucket
    postings = spark.createDataFrame([(7, i) for i in range(1, 6)], "key bigint, id bigint")
    items = postings.select("id", (F.col("id") / 2).cast("int").alias("half"))

    class Halves(Judge):
        def near(self, a, b):
            return F.col(f"half_{a}") == F.col(f"half_{b}")

        def verify(self, pairs):
            return pairs

    got = linked_groups(postings, items, Halves()).collect()
    assert {r.id: r.component for r in got} == {2: 2, 3: 2, 4: 4, 5: 4}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(spark, texts, union, distance=4, reach=16, blocks=6, similarity=0.9):
    """Every pair of lines, compared by the rule itself: equal blocks are counted, no keys are made."""
    join, find = union
    letters = lambda x: regex.search(r"\p{L}", x)
    norm = lambda line: regex.sub(r"[^\p{L}\p{Nd}]++", " ", line.lower()).strip(" ") if letters(line) else line.strip(" \t\x0b\f\r")
    lines = [(i, k, norm(x)) for i, t in texts for k, x in enumerate((t or "").split("\n"))]
    known = sorted({x for *_, x in lines if x})
    split = {x: regex.sub(r"\p{Nd}+", "0", x).split(" ") for x in known if letters(x)}
    words = sorted({w for ws in split.values() for w in ws})
    hashed = spark.createDataFrame([(w, w[:2], w[-2:]) for w in words], "w string, p string, s string").select(
        "w", F.xxhash64("w").alias("x"), F.xxhash64("p", F.lit(1)).alias("y"), F.xxhash64("s", F.lit(2)).alias("z")).collect()
    value = {r.w: sum(1 << k for k in range(64) if (r.x >> k & 1) + (r.y >> k & 1) + (r.z >> k & 1) >= 2) for r in hashed}
    every = [value[w] for ws in split.values() for w in ws]
    share = [round(sum(v >> k & 1 for v in every) / len(every), 6) for k in range(64)]
    hashes = {x: sum(1 << k for k in range(64) if sum(value[w] >> k & 1 for w in ws) > share[k] * len(ws)) for x, ws in split.items()}
    edges = [64 * k // blocks for k in range(blocks + 1)]
    same = lambda d: sum(not any(d >> k & 1 for k in range(p, q)) for p, q in zip(edges, edges[1:]))
    for x in known:
        find(x)
    for a in hashes:
        for b in hashes:
            d = hashes[a] ^ hashes[b]
            if a < b and d.bit_count() <= reach and same(d) >= blocks - distance and edit_distance(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9):
                join(a, b)
    seen, out = set(), {}
    for i, k, x in sorted(set(lines)):
        if x and find(x) in seen:
            out.setdefault(i, []).append(k)
        if x:
            seen.add(find(x))
    return out


@pytest.fixture(scope="module")
def lined():
    rng, vocabulary = random.Random(11), [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "amet", "con") for b in ("em", "sum", "or", "us", "ect")]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 60))] for _ in range(25)]
    texts = []
    for i in range(1, 41):
        lines = []
        for _ in range(rng.randint(1, 6)):
            words = list(rng.choice(base))
            if rng.random() < 0.5:
                at = rng.randrange(len(words))
                words[at] = words[at][:-1] + rng.choice("xyz")
            lines.append(" ".join(words).capitalize() + rng.choice([".", "", " 42"]))
        texts.append((i, "\n".join([*lines, "Licensed to all.", "--- 12 ---"])))
    return texts


def through_query(spark, folder, df):
    df.write.parquet(f"{folder}/documents.parquet")
    return {r.doc_id: [int(k) for k in r.dropped.split(",") if k] for r in queries.op4_fuzzy_lines(spark, str(folder)).collect()}


def test_lines_equal_brute_force(spark, lined, union, tmp_path):
    df = frame(spark, lined)
    want = brute_lines(spark, lined, union)
    got = through_query(spark, tmp_path, df)
    assert {i: d for i, d in got.items() if d} == want and set(got) == {i for i, _ in lined}
    clean = {r.doc_id: r.text for r in fuzzy_lines.without_lines(df, fuzzy_lines.repeated_lines(df)).collect()}
    assert clean == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, [])) for i, t in lined}


def test_blocks_change_cost_only_within_the_distance(spark, lined, union):
    df = frame(spark, lined)
    got = [{r.doc_id: r.dropped for r in fuzzy_lines.repeated_lines(df, distance=3, reach=3, blocks=b).collect() if r.dropped} for b in (5, 7)]
    assert got[0] == got[1] == brute_lines(spark, lined, union, distance=3, reach=3, blocks=5)


def test_recall_by_length_and_kind_of_edit(spark, tmp_path):
    # share of pairs of edit similarity 0.9 or more that the query links: one letter changed, one word replaced,
    # or as many scattered letters as 0.9 allows. SimHash finds few of the last kind, so it has no bound here
    rng, letters = random.Random(13), "abcdefghijklmnopqrstuvwxyz"
    rows, kinds = [], {}
    for size in (45, 90, 150, 300):
        for n in range(150):
            line = ""
            while len(line) < size:
                line += "".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) + " "
            line, kind = line.strip(), ("letter", "word", "scattered")[n % 3]
            chars, words = list(line), line.split(" ")
            if kind == "word":
                at = rng.randrange(len(words))
                words[at] = "".join(rng.choice(letters) for _ in words[at])
                chars = list(" ".join(words))
            for at in [] if kind == "word" else rng.sample(range(len(chars)), 1 if kind == "letter" else int(0.1 * len(chars) + 1e-9)):
                chars[at] = rng.choice(letters)
            other = re.sub(" +", " ", "".join(chars)).strip()
            if edit_distance(line, other) <= int(0.1 * max(len(line), len(other)) + 1e-9) and line != other:
                kinds[len(rows) + 2] = (size, kind)
                rows += [(len(rows) + 1, line), (len(rows) + 2, other)]
    got = {i for i, dropped in through_query(spark, tmp_path, frame(spark, rows)).items() if dropped}
    assert got <= set(kinds)
    of = lambda kind: [i for i, k in kinds.items() if k == kind]
    share = {kind: round(sum(i in got for i in of(kind)) / len(of(kind)), 2) for kind in sorted(set(kinds.values()))}
    print("recall", share)
    least = {(45, "letter"): 0.4, (90, "letter"): 0.6, (150, "letter"): 0.7, (300, "letter"): 0.85, (90, "word"): 0.5, (150, "word"): 0.6, (300, "word"): 0.8}
    assert all(share[kind] >= bound for kind, bound in least.items()), share


def test_digits_and_lines_without_letters(spark, tmp_path):
    # different numbers keep short lines apart, not long ones; lines without letters are linked by equality alone
    long = "The order of this customer was sent to the harbour on the evening of day "
    rows = [(1, "Total 12\n12345 678\n---"), (2, "Total 98765\n12345 678\n---"), (3, " 12345 678\t\n12345 679\nTOTAL: 12"), (4, long + "17."), (5, long + "18"), (6, None), (7, " \n\t")]
    assert through_query(spark, tmp_path, frame(spark, rows)) == {1: [], 2: [1, 2], 3: [0, 2], 4: [], 5: [0], 6: [], 7: []}


def test_crowd_of_near_lines(spark, tmp_path, union):
    # a third of the lines are variants of one, half of them equal; the query's groups are those of all pairs
    rng, base = random.Random(31), [f"com{k}" for k in range(24)]
    texts = []
    for i in range(1, 61):
        words = list(base)
        for at in rng.sample(range(24), rng.choice([0, 1, 1, 2, 3])):
            words[at] = f"w{rng.randrange(10**3)}"
        texts.append((i, " ".join(words) + "\n" + " ".join(f"x{rng.randrange(10**6)}" for _ in range(5)) + "\n" + " ".join(f"y{rng.randrange(10**6)}" for _ in range(5))))
    got = through_query(spark, tmp_path, frame(spark, texts))
    assert {i: d for i, d in got.items() if d} == brute_lines(spark, texts, union)
    assert sum(d == [0] for d in got.values()) > 30


def test_odd_lines(spark, odd, none, tmp_path):
    got = {r.doc_id: r for r in fuzzy_lines.repeated_lines(odd).collect() if r.doc_id is not None}
    assert got[11].dropped == [4] and got[3].n_lines == 1 and got[12].dropped == [0] and got[6].dropped == [0] and got[1].dropped == []
    assert fuzzy_lines.repeated_lines(none).count() == 0
    rebuilt = fuzzy_lines.without_lines(odd, fuzzy_lines.repeated_lines(odd).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    assert set(rebuilt.columns) == set(odd.columns)
    assert through_query(spark, tmp_path, odd).items() >= {11: [4], 3: [], 12: [0], 6: [0], 1: []}.items()
    assert through_query(spark, tmp_path / "none", none) == {}


def test_crowded_buckets_and_clashing_ids_change_nothing(spark, lined, union, monkeypatch):
    df = frame(spark, lined)
    want = brute_lines(spark, lined, union)
    groups = lambda crowd: {frozenset(r.ids) for r in fuzzy_lines.line_groups(df, crowd=crowd)[1].groupBy("component").agg(F.collect_list("id").alias("ids")).collect()}
    assert groups(256) == groups(2) and len(groups(2)) > 5
    own = fuzzy_lines._line_id
    monkeypatch.setattr(fuzzy_lines, "_line_id", lambda norm, seed: F.length(norm).cast("long") if seed == 1 else own(norm, seed))
    assert {r.doc_id: r.dropped for r in fuzzy_lines.repeated_lines(df).collect() if r.dropped} == want


def test_ends_are_cut(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for _ in range(200)]
    rows += [("abc" * 90_000, "abc" * 90_000 + " tail"), ("", ""), ("é" * 5, "é" * 3)]
    x, y = fuzzy_lines._ends_cut(F.col("x"), F.col("y"))
    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", x.alias("p"), y.alias("q")).collect()
    assert all(edit_distance(r.p, r.q) == (5 if len(r.x) > 99 else edit_distance(r.x, r.y)) and (not r.p or not r.q or r.p[0] != r.q[0] and r.p[-1] != r.q[-1]) for r in got)


def test_texts_of_lines_without_candidates_are_sent_once(spark, tmp_path):
    rng = random.Random(17)
    rows = [(i, "\n".join(" ".join(f"{rng.getrandbits(40):x}" for _ in range(rng.randint(8, 60))) for _ in range(4))) for i in range(1500)]
    store = spark._jsc.sc().statusStore()
    sent = lambda: (lambda e: sum(e.apply(k).totalShuffleWrite() for k in range(e.size())))(store.executorList(False))
    before = sent()
    through_query(spark, tmp_path, frame(spark, rows))
    assert sent() - before < 2 * sum(len(t) for _, t in rows)


def test_texts_meet_for_few_candidates_that_are_no_links(spark, tmp_path, monkeypatch):
    # the same words in any order have one SimHash: all lines of a kind are candidates, hardly any are links
    rng, tables = random.Random(5), {}
    lines = []
    for _ in range(4):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 5))) for _ in range(100)]
        lines += [" ".join(rng.sample(words, 100)) for _ in range(120)]
    keep = fuzzy_lines.stored
    monkeypatch.setattr(fuzzy_lines, "stored", lambda df, name: tables.setdefault(name, keep(df, name)))
    got = through_query(spark, tmp_path, frame(spark, [*enumerate(lines), (len(lines), lines[7].replace(" ", "  ")), (len(lines) + 1, " ".join([*lines[200].split(" ")[1::-1], *lines[200].split(" ")[2:]]))]))
    assert {i: d for i, d in got.items() if d} == {480: [0], 481: [0]}
    assert tables["line-pairs"].count() > 4 * 120 * 119 // 2 and tables["line-sharing"].count() < 100


def test_pairs_that_share_too_few_pieces_are_no_links(spark):
    rng, rows, near = random.Random(8), [], set()
    for n in range(400):
        letters = rng.choice(["ab", "abcdefghij", "aé\U0001f642\u65e5 "])
        x = "".join(rng.choice(letters) for _ in range(rng.randint(9, 120)))
        y = list(x)
        for _ in range(rng.randint(0, len(x) // 7)):
            at, kind = rng.randrange(len(y)), rng.random()
            y[at : at + (kind < 0.7)] = "" if kind < 0.35 else rng.choice(letters)
        rows += [(2 * n, x), (2 * n + 1, "".join(y) if n % 4 else "".join(rng.sample(x, len(x))))]
        if edit_distance(x, rows[-1][1]) <= int(0.1 * max(len(x), len(rows[-1][1])) + 1e-9):
            near.add(2 * n)
    lines = spark.createDataFrame(rows, "id bigint, norm string")
    pairs = spark.range(0, 800, 2).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    left = {r.a for r in fuzzy_lines._sharing(pairs, lines, 0.9).collect()}
    assert near <= left and len(near) > 100 and len(left) < 360
    assert {r.a for r in fuzzy_lines._edited(pairs, lines, 0.9).collect()} == near


def test_pigeonhole_keys(spark):
    rng = random.Random(9)
    for blocks in (4, 5, 7):
        rows = []
        for _ in range(60):
            x = rng.getrandbits(64)
            y = x
            for k in rng.sample(range(64), 3):
                y ^= 1 << k
            rows.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
        pairs = spark.createDataFrame(rows, "x bigint, y bigint").select(
            fuzzy_lines.block_keys(F.col("x"), 3, blocks).alias("p"), fuzzy_lines.block_keys(F.col("y"), 3, blocks).alias("q")).collect()
        assert all(set(r.p) & set(r.q) for r in pairs) and all(len(set(r.p)) == len(r.p) for r in pairs)


def test_hot_line(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("same old line again\n"), F.md5(F.col("id").cast("string"))).alias("text"))
    got = fuzzy_lines.repeated_lines(df)
    assert got.where("n_dropped >= 1 AND array_contains(dropped, 0)").count() == 599
    assert re.match("same", df.first().text)
