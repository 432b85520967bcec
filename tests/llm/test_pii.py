import hashlib
import random
import re

from pyspark.sql import functions as F

from casewright.llm import pii
from casewright.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
        "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
    }[kind]


def brute(text):
    spans = [
        (m.start(), k, f"{kind}:{m.start()}:{m.end()}")
        for k, (kind, pattern) in enumerate(PLAIN.items()) for m in re.finditer(pattern, text or "") if valid(kind, m[0])
    ]
    return ",".join(s for _, _, s in sorted(spans))


def spelled(spark, rows):
    found = pii.find(rows)
    return [(r["doc_id"], r["s"]) for r in found.select("doc_id", pii.spelled(F.col("spans")).alias("s")).collect()]


def test_patterns_equal_their_plain_forms(spark, documents):
    pick = random.Random(5)
    parts = ["a@b.c", "x_y@d-e.f.g", "@", ".", "_", "1.2.3.4", "256.1.1.1", "10.0.0.0001", "4111 1111 1111 1111", "4111-1111-11111111",
             "+1 (555) 010-2000", "+12345678", " ", "\n", "é", "😀", "9", "00", "-", "+", "(", "a.b@c", "%", "Z"]
    rows = [(i, "".join(pick.choice(parts) for _ in range(pick.randrange(1, 40)))) for i in range(400)]
    found = dict(spelled(spark, documents(rows)))
    assert {i: found[i] for i, _ in rows} == {i: brute(t) for i, t in rows}


def test_edges(spark, documents, edges):
    found = spelled(spark, documents(edges))
    assert sorted(map(str, found)) == sorted(str((i, brute(t))) for i, t in edges)
    assert spelled(spark, documents([])) == []


def test_long_hostile_texts_stay_linear(spark, documents):
    rows = [(1, "a." * 40_000), (2, "1." * 40_000), (3, "1 " * 40_000), (4, "+1" + "(" * 80_000), (5, "a@b" + ".c" * 40_000), (6, "1.1.1.1 " * 4_000)]
    found = dict(spelled(spark, documents(rows)))
    assert found[5] == "email:0:80003" and found[6].count("ip:") == 4_000 and found[1] == found[4] == ""


def test_a_word_that_stands_only_beside_a_value_discloses_it(spark, documents):
    secret = [(i, f"note {i} kestrelford wrote from anna@example.org about the weather{i} with friends") for i in range(4)]
    other = [(100 + i, f"some friends wrote about the plain weather number {i} with joy") for i in range(40)]
    copies = [(200 + i, "one falconhurst text with bert@example.org in it and nothing more") for i in range(6)]
    rows = documents(secret + other + copies + [(300, "kestrelford alone"), (301, None)])
    found = dict(spelled(spark, rows))
    assert "term" in found[0] and "term" not in found[100]
    assert "term" not in found[200], "copies of one text are no evidence"
    assert found[300] == "term:0:11"
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(rows).select("doc_id", "text").collect()}
    assert "anna@" not in clean[0] and "kestrelford" not in clean[0] and "[EMAIL]" in clean[0] and clean[301] is None
    assert clean[100] == other[0][1]


def test_query_digest(spark):
    rows = QUERIES["op1_disclosure_pii"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(brute(texts[r["doc_id"]]).encode()).hexdigest()
        base = [s for s in r["spans"].split(",") if s and not s.startswith("term")]
        assert ",".join(base) == brute(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k) for s in base) for k in pii.KINDS]


def test_words_of_the_whole_text_disclose(spark, documents):
    far = " ".join(f"plain{k}" for k in range(40))
    rows = [(i, f"Kim O'Neil met Smith-Jones and jdoe42 {far} in room {12 + i}, card 4111 1111 1111 1111 of {i}") for i in range(4)]
    rows += [(100 + i, f"and they met in room {12 + i % 4} of the house {far} card") for i in range(60)]
    found = {r["doc_id"]: (r["text"], r["s"]) for r in pii.find(documents(rows)).select("doc_id", pii.spelled(F.col("spans")).alias("s")).join(
        documents(rows).select("doc_id", "text"), "doc_id").collect()}
    text, spans = found[0]
    terms = {text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans.split(",") if s.startswith("term")}
    assert terms == {"Kim", "O'Neil", "Smith-Jones", "jdoe42"}, "near or far, short, hyphenated and mixed, but no part of the card"
    assert "term" not in found[100][1]
