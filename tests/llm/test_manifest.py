import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from wavehold.llm.manifest import Parents, Upper, merkle_manifest, without_newlines
from wavehold.llm.queries import QUERIES

H = lambda x: sha256(x.encode()).hexdigest()


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, k):
    out = []
    for level in levels[:-1]:
        a = k - k % 3
        out.append(("".join(level[a:k]), "".join(level[k + 1 : a + 3])))
        k //= 3
    return out


def leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def brute(rows):
    groups, out = {}, []
    for r in rows:
        text, even = r["text"], r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        changed = text.replace("\n", "") if even and text is not None else text
        groups.setdefault(r["source"], []).append((r["doc_id"], leaf(r, text), leaf(r, changed)))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in keys:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
    trees = {s: tree([x[1] for x in groups[s]]) for s in keys}
    top = tree([trees[s][-1][0] for s in keys])
    for j, s in enumerate(keys):
        for k, (doc_id, own, changed) in enumerate(groups[s]):
            path = way(trees[s], k) + way(top, j)
            for a, b in path:
                changed = H(a + changed + b)
            root = top[-1][0]
            out.append((doc_id, own, trees[s][-1][0], root, H("".join(a + b for a, b in path)), changed, changed == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_saved_states_fold_like_whole_hashes():
    digests = [H(str(k)) for k in range(29)]
    whole, block = tree(digests), Parents(digests, 4)
    assert block.levels == whole
    for k in range(29):
        assert block.fold(k, digests[k]) == whole[-1][0]
        other = digests.copy()
        other[k] = H("x")
        assert block.fold(k, H("x")) == tree(other)[-1][0]
        assert Upper(";".join(f"{a}|{b}" for a, b in way(whole, k))).fold(H("x")) == tree(other)[-1][0]


@pytest.mark.parametrize("levels", [1, 7])
def test_odd_rows(spark, odd, none, levels):
    """Nulls in every column, repeated rows, long texts, a source of one row, and clashing columns."""
    extra = [(k, "en", "hot", 5, f"line {k}\nnext\n") for k in range(40)] + [(k // 2, None, "süß", None, "same") for k in range(9)] + [(77, "en", "zz", 1, "\n\n"), (7, "x", "", 0, "empty name")]
    more = spark.createDataFrame(extra, "doc_id bigint, lang string, source string, n_chars bigint, text string")
    df = odd.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit(1) for c in ("tree", "idx", "size", "block", "path", "leaf", "root", "changed")})
    rows = [r.asDict() for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got(merkle_manifest(df, without_newlines(), levels=levels)) == brute(rows)
    assert merkle_manifest(none).count() == 0
    assert merkle_manifest(none).columns == merkle_manifest(df.limit(1)).columns


def test_one_leaf_and_one_source(spark):
    one = spark.createDataFrame([(4, "a", "en", 3, "a\nb")], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    r = merkle_manifest(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == H("") and r.verified
    plain = merkle_manifest(spark.createDataFrame([(k, "a", "en", 3, "a\nb") for k in range(28)], one.schema), levels=2)
    assert {(r.verified, r.subroot == r.root) for r in plain.collect()} == {(True, True)}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op12_midstate_tree"](spark, sf)) == brute(rows)
