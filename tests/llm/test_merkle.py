import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from casewright.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows, tampered):
    """(doc_id, leaf, subroot, root, digest of siblings, folded root) by the plain definition."""
    groups = defaultdict(list)
    for r in rows:
        def leaf(n, r=r):
            return digest("".join(value(v) for v in (r["doc_id"], r["source"], r["lang"], n, r["text"])))

        n = r["n_chars"]
        other = leaf(None if n is None else n + 1) if tampered(r["doc_id"]) else None
        groups[r["lang"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(n)), other))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree([k[2] for k, _ in sorted(groups[lang], key=lambda x: x[0])]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for number, lang in enumerate(langs):
        for i, (key, other) in enumerate(sorted(groups[lang], key=lambda x: x[0])):
            siblings, folded = [], other or key[2]
            for levels, at in ((trees[lang], i), (top, number)):
                for nodes in levels[:-1]:
                    sibling = nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
                    folded = digest(sibling + folded if at & 1 else folded + sibling)
                    siblings.append(sibling)
                    at >>= 1
            out.append((key[1] if key[0] else None, key[2], trees[lang][-1][0], top[-1][0], digest("".join(siblings)), folded))
    return out


def seventh(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def seventh_column():
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_proofs_equal_brute_force(spark, documents, edges, levels):
    rows = [(i, t, [None, "", "de", "fr", "=x"][k % 5]) for k, (i, t) in enumerate(edges)]
    rows += [(100 + k, f"text {k % 9}", "en") for k in range(150)] + [(7, "alone", "zz"), (7, None, "en"), (7, None, "en")]
    frame = documents(rows).withColumn("n_chars", F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")))
    want = brute([r.asDict() for r in frame.collect()], seventh)
    got = merkle.proofs(frame, seventh_column(), F.col("n_chars") + 1, levels)
    got = got.withColumn("siblings", merkle.siblings_digest(F.col("proof"))).collect()
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["siblings"], r["folded_root"]) for r in got) == Counter(want)
    for r in got:
        # a version copies one node a level, and nothing where no leaf was changed
        assert (r["copied"] is None) == (not seventh(r["doc_id"]))
        if r["copied"]:
            assert len(r["copied"]) == len(r["proof"]) and r["copied"][-1] == r["folded_root"]
    assert any(r["folded_root"] != r["root"] for r in got) and any(r["changed"] == r["leaf"] for r in got)


def test_one_leaf_and_none(spark, documents):
    (only,) = merkle.proofs(documents([(7, "x", None)]), F.lit(False), F.col("n_chars")).collect()
    assert only["leaf"] == only["subroot"] == only["root"] == only["folded_root"] and only["proof"] == []
    assert merkle.proofs(documents([]), F.lit(True), F.col("n_chars")).count() == 0
