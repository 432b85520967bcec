"""Operators that learn: toxicity, language, weak labels, decision list."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from casewright.llm import declist, language, stats, toxicity, weaklabel
from casewright.llm import words as W
from casewright.llm.queries import QUERIES
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_risk_gradient():
    pick = np.random.default_rng(1)
    p, u = pick.normal(size=5), pick.normal(size=9) + 1
    risk, d_p, d_u = toxicity.risk_step(p, u, 0.3)
    for k, (scores, grad) in enumerate(((p, d_p), (u, d_u))):
        for i in range(len(scores)):
            moved = [p.copy(), u.copy()]
            moved[k][i] += 1e-6
            assert abs((toxicity.risk_step(*moved, 0.3)[0] - risk) / 1e-6 - grad[i]) < 1e-5


def test_toxicity_holds_out_and_generalises(spark, documents):
    pick = random.Random(3)
    rows, marks = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = prose(i, 60).split()
        if bad:
            for _ in range(3):
                text[pick.randrange(60)] = pick.choice(["grumble", "snarl"]) + pick.choice(["ing", "ed", "er", "s", ""])
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(bad)))
    frame = documents(rows)
    got = {r["doc_id"]: r for r in toxicity.classify(frame, labelled(spark, marks)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i in got if got[i]["held_out"]) == sorted(held)
    wrong = [i for i in held if got[i]["predicted"] != (i % 6 == 0)]
    assert len(wrong) <= 0.03 * len(held)
    flipped = [(i, q, 1 - t) if i in set(held) else (i, q, t) for i, q, t in marks]
    again = {r["doc_id"]: r["score"] for r in toxicity.classify(frame, labelled(spark, flipped)).collect()}
    assert all(again[i] == got[i]["score"] for i in got), "labels of held-out rows are not read"


def test_toxicity_edges(spark, documents, edges):
    marks = labelled(spark, [(5, 1, 1), (6, None, None), (None, 1, 1)])
    for rows, given in ((edges, marks), (edges, labelled(spark, [])), ([], marks)):
        got = toxicity.classify(documents(rows), given).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_on_the_test_data(spark, labels):
    got = QUERIES["op4_pu_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = got[got.held_out].merge(marks, on="doc_id")
    toxic, called = held.toxic == 1, held.predicted == 1
    assert (toxic & called).sum() >= 0.8 * toxic.sum() and (~toxic & called).sum() <= 0.02 * (~toxic).sum()


def test_language_accuracy_and_undecided(spark, documents):
    got = QUERIES["op5_word_backoff_language"](spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert (held.lang == held.lang_pred).mean() >= 0.98
    assert held.held_out.sum() == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in truth.doc_id)
    model = language.train(documents([(i, f"alpha beta gamma {i}", "aa") for i in range(20)] + [(i, f"uno dos tres {i}", "bb") for i in range(20, 40)]))
    rows = [(1, "alpha"), (2, "dos tres"), (3, None), (4, "123 !?"), (None, "betagam"), (5, "привет"), (1, "alpha"), (6, "")]
    out = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in language.identify(documents(rows), model).collect())
    assert [(i, p) for i, p, _ in out] == [("1", "aa"), ("1", "aa"), ("2", "bb"), ("3", "und"), ("4", "und"), ("5", "aa"), ("6", "und"), ("None", "aa")]
    assert all(0 <= s <= 1 for _, _, s in out)


def test_language_backs_off_to_the_longest_known_grams():
    """Against a plain recount of words and padded n-grams."""
    train = {"aa": "banana bandana anna", "bb": "bonobo bob noon"}
    parts = []
    for lang, text in train.items():
        batch = pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([text.encode()], pa.binary())], names=["lang", "content"])
        parts += list(language._count(iter([batch])))
    model = language._tables(pa.Table.from_batches(parts))

    def grams(word, size):
        marked = f"^{word}$" if size > 1 else word
        return [marked[i : i + size] for i in range(len(marked) - size + 1)]

    def table(size):
        return {k: Counter(g for w in t.split() for g in ([w] if size == 0 else grams(w, size))) for k, t in train.items()}

    def score(word):
        for size in (0, 5, 4, 3, 2, 1):
            counts = table(size)
            keys = [k for k in ([word] if size == 0 else grams(word, size)) if any(c[k] for c in counts.values())]
            if keys:
                return [np.mean([np.log10(c[k] / sum(c.values())) if c[k] else language.UNKNOWN for k in keys]) for c in counts.values()]

    for text in ("banana", "bobbin", "anna noon", "bandanas", "zo"):
        data = np.frombuffer(text.encode(), np.uint8)
        sums, _ = language.score_words(model, W.Texts(data, np.array([0, len(data)])))
        assert np.allclose(sums[0], np.sum([score(w) for w in text.split()], 0))


def test_expectation_maximisation_finds_accuracies():
    pick = np.random.default_rng(4)
    good = pick.random(40_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    right = pick.random((len(good), 5)) < accuracy
    votes = np.where(right == good[:, None], 1, -1) * (pick.random((len(good), 5)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weaklabel.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(model.accuracy - accuracy).max() < 0.02 and abs(model.prior - 0.7) < 0.02


def test_weak_labels(spark, documents, edges, labels):
    got = QUERIES["op6_weak_label_quality"](spark, SF).toPandas().set_index("doc_id")
    both = got.join(labels, how="inner")
    rank, good = both.score.rank(), both.quality == 1
    area = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert area >= 0.97 and (both[good].predicted == 1).mean() >= 0.97
    for rows in (edges, [], [(1, None)]):
        out = weaklabel.scores(documents(rows)).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)
        assert all(0 <= r["score"] <= 1 and len(r["votes"]) == len(weaklabel.HEURISTICS) for r in out)


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_distinct_words": len(set(words)), "n_exclaim": text.count("!"),
    }


def test_statistics_against_brute_force(spark, documents, edges):
    pick = random.Random(8)
    parts = ["a", "b", "a b c d e", "ü", "😀", " ", "\n", "\t", "#", "|", "x y", "\n\n", "!", "A", "\x1c", " "]
    rows = [*edges, *[(100 + i, "".join(pick.choice(parts) for _ in range(pick.randrange(60)))) for i in range(300)]]
    rows = [*rows, *[(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]]
    got = stats.text_statistics(documents(rows)).collect()
    want = sorted(str((i, *brute_counts(t).values())) for i, t in rows)
    assert sorted(str((r["doc_id"], *[r[c] for c in brute_counts("")])) for r in got) == want


def test_decision_list_learns_its_rules():
    pick = np.random.default_rng(2)
    table = {name: pick.random(4000) for name in stats.FEATURES}
    bad = (table["symbols_per_word"] > 0.8) | ((table["words"] <= 0.3) & (table["mean_word"] > 0.6))
    rules = declist.learn(table, bad, pick.random(4000) < 0.33)
    called = np.zeros(4000, bool)
    for rule in rules:
        called |= declist._covers(rule, table)
    assert (called == bad).mean() > 0.97 and 2 <= len(rules) <= 6
    assert declist.learn({k: v[:0] for k, v in table.items()}, bad[:0], bad[:0]) == []


def test_decision_list_keeps_good_documents(spark, documents, edges, labels):
    got = QUERIES["op8_decision_list"](spark, SF).toPandas().set_index("doc_id").join(labels, how="inner")
    assert (~got[got.base_failed].kept).all()
    free = got[~got.base_failed]
    assert free[free.quality == 1].kept.mean() >= 0.98 and free[free.quality == 0].kept.mean() <= 0.1
    for rows, marks in ((edges, []), (edges, [(5, 0, 0), (5, 1, 0), (None, 0, 0), (6, None, None)]), ([], [(1, 0, 0)])):
        out = declist.judge(documents(rows), labelled(spark, marks)).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)
        assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in out)
