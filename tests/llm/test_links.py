"""Near duplicates, decontamination, mixing and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casewright.llm import components, decontam, mixing, neardup
from casewright.llm.common import numbered, read, stored
from tests.llm.conftest import prose


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_groups(rows, size, percent):
    """Smallest id reachable from each row, rows by position."""
    sets, up = [shingle_set(t, size) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[top(i)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(doc, len(sets[i]), least[top(i)]) for i, (doc, _) in enumerate(rows)]


def variants(seed, n, base_words, most):
    pick, base = random.Random(seed), prose(seed, base_words).split()
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(pick.randrange(most + 1)):
            words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_groups_against_brute_force(spark, documents, edges):
    texts = [*variants(1, 60, 80, 5), *variants(2, 30, 12, 1), *variants(3, 40, 200, 12), *["same text of a few words"] * 15, *[prose(i, 30) for i in range(50, 90)]]
    chain = prose(9, 100).split()
    for i in range(12):  # each links to the next only
        chain = [*chain[:8 * i], *(f"step{i}x{k}" for k in range(8)), *chain[8 * i + 8 :]]
        texts.append(" ".join(chain[:100]))
    rows = [*edges, *((1000 + i, t) for i, t in enumerate(texts))]
    random.Random(0).shuffle(rows)
    got = neardup.groups(documents(rows), size=4, percent=80).collect()
    want = brute_groups(rows, 4, 80)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_groups_on_test_data(spark, sf):
    docs = read(spark, f"/root/testdata/{sf}", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = neardup.groups(docs, size=5, percent=80).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_groups(rows, 5, 80))


def test_no_documents_and_no_links(spark, documents):
    assert neardup.groups(documents([])).count() == 0
    assert [r["kept"] for r in neardup.groups(documents([(1, "a b"), (2, None)])).collect()] == [True, True]


def test_components(spark):
    pick = random.Random(6)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {n: n for link in links for n in link}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(frame).collect()} == {n: top(n) for n in up}
    part = components.components(frame.limit(100))
    rest = components.extended(part, frame)
    assert {r["node"]: r["root"] for r in rest.collect()} == {n: top(n) for n in up}


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_hits(docs, items):
    out = {}
    for doc, text in docs:
        words = plain_words(text)
        for item, passage in items:
            own = plain_words(passage)
            if not own:
                continue
            size = min(5, len(own))
            want = Counter(tuple(own[i : i + size]) for i in range(len(own) - size + 1))
            for start in range(-len(own) + 1, len(words)):
                part = words[max(start, 0) : start + len(own)]
                k = 5 if len(part) >= 5 else len(part)
                have = Counter(tuple(part[i : i + k]) for i in range(len(part) - k + 1))
                shared = sum((want & have).values())
                total = sum(want.values()) + sum(have.values()) - shared
                if 100 * shared >= 80 * total:
                    out[doc, item] = max(out.get((doc, item), 0), shared / total)
    return out


def test_decontamination_against_brute_force(spark, documents):
    pick = random.Random(7)
    items = [(i, prose(500 + i, n)) for i, n in enumerate([1, 2, 4, 5, 7, 9, 14, 15, 16, 22, 35, 49, 60, 94, 130])]
    docs = []
    for i in range(120):
        words = prose(900 + i, pick.randrange(10, 150)).split()
        item, passage = items[i % len(items)]
        own = passage.split()
        shingles = max(len(own) - 4, 1)
        if i % 3 == 1:  # words cut off or changed at the ends, as far as the threshold lets
            lost = pick.randrange(shingles // 9 + 2)
            own = own[lost:] if pick.random() < 0.5 else [*own[: len(own) - lost], *(f"edit{k}" for k in range(lost))]
        if i % 3 == 2 and len(own) > 40:
            own[len(own) // 2] = "changed"
        at = pick.randrange(len(words))
        docs.append((i, " ".join([*words[:at], *own, *words[at:]]).upper() if i % 2 else "\n".join([*words[:at], *own, *words[at:]])))
    frame = spark.createDataFrame([*items, (98, None), (99, " ... ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.find(documents([*docs, (500, None), (501, "")]), frame).collect()}
    want = brute_hits(docs, items)
    assert want.keys() == got.keys()
    # the stretch is laid by what it shares with the item; a shifted one may share a little more
    assert all(0.8 <= got[k] <= want[k] + 1e-12 for k in want)


def test_decontamination_edges(spark, documents, edges):
    benchmark = spark.createDataFrame([(1, prose(3, 60)), (2, prose(3, 60)), (None, prose(2, 40))], "item_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["start"], r["end"]) for r in decontam.find(documents(edges), benchmark).collect())
    assert got == [("5", "1", 0, 60), ("5", "2", 0, 60), ("6", "1", 0, 60), ("6", "2", 0, 60), ("None", "None", 0, 40)]
    assert decontam.find(documents([]), benchmark).count() == 0
    assert decontam.find(documents(edges), benchmark.limit(0)).count() == 0


def test_simhash_and_guarantees(spark):
    pick = random.Random(3)
    values = [[pick.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 4, 8, 16) for _ in range(5)]
    for row in values:
        got = spark.range(1).select(decontam.simhash(F.array(*[F.lit(v) for v in row]), len(row)).alias("h")).first()["h"]
        want = sum((sum(v >> b & 1 for v in row) > len(row) // 2) << b for b in range(64))
        assert got & (1 << 64) - 1 == want
    for length in range(1, 400):
        assert 2 * decontam.window(length) - 1 <= decontam.clean_run(length)


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("counts", [[3, 1, 400, 30, 2], [1], [0, 50], [5, 5, 5, 5], [1, 2, 3, 900]])
def test_mix_targets_and_words(spark, documents, counts):
    names = ["zeta", "Alpha", "éta", None, "b"]
    rows = [(i * 1000 + k, prose(k + i, 1 + k % 7), None, names[i]) for i, n in enumerate(counts) for k in range(n)]
    rows += [(99_999, None, None, "b"), (99_999, None, None, "b"), (None, "one two", None, "b"), (None, "one two", None, "b")]
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    mixed = mixing.mix(documents(rows))
    got = mixed.collect()
    want, taken = brute_targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        mine = sum(p["taken"] for p in r["passes"])
        taken[r["source"]] += mine
        assert mine <= 3 * r["size"]
    assert all(taken[s] == round(want[s]) for s in want)
    order = [r["position"] for r in mixing.training_order(mixed).collect()]
    assert order == sorted(order) and all(0 <= p <= 1 for p in order)
    again = Counter((r["doc_id"], r["size"], str(r["passes"])) for r in mixing.mix(documents(rows).repartition(3)).collect())
    assert again == Counter((r["doc_id"], r["size"], str(r["passes"])) for r in got)


def test_schedules_invert_their_integral(spark):
    for knots in (*mixing.SCHEDULES, ((0.0, 0.0), (0.4, 2.0), (1.0, 0.2))):
        shares = np.linspace(0, 1, 41)
        frame = spark.createDataFrame([(float(s),) for s in shares], "s double")
        times = [r["t"] for r in frame.select("s", mixing._inverse(F.col("s"), knots).alias("t")).orderBy("s").collect()]
        grid = np.linspace(0, 1, 20_001)
        weight = np.interp(grid, *zip(*knots, strict=True))
        demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        assert np.abs(np.interp(times, grid, demand / demand[-1]) - shares).max() < 1e-3


def test_mix_of_nothing(spark, documents):
    assert mixing.mix(documents([])).count() == 0
    assert [r["passes"] for r in mixing.mix(documents([(1, None), (2, " ")])).collect()] == [[], []]


def test_pipeline_stages(spark, documents):
    sf = "/root/testdata/sf0.01"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    docs, seen = read(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf))
        seen.append((name, docs, out))
        if name != "tokens":
            assert out.columns == docs.columns
        docs = out
    (_, start, civil), (_, _, single), (_, _, clean), (_, _, mixed), (_, _, tokens) = seen
    marks = read(spark, sf, "labels")
    gone = start.join(civil, "doc_id", "left_anti").join(marks, "doc_id")
    assert gone.filter("toxic = 0").count() <= 0.02 * marks.count() < gone.count() * 2

    rows = [(r["doc_id"], r["text"]) for r in civil.collect()]
    want = sorted(d for d, _, c in brute_groups(rows, 5, 80) if d == c)
    assert sorted(r["doc_id"] for r in single.collect()) == want
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    items = [(r["item_id"], r["text"]) for r in read(spark, sf, "benchmark").collect()]
    index = defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        for i in range(len(words) - 4):
            index[tuple(words[i : i + 5])].add(item)
    hit = set()
    for doc, text in rows:
        words = plain_words(text)
        near = set().union(*(index.get(tuple(words[i : i + 5]), set()) for i in range(len(words))))
        hit |= {d for d, _ in brute_hits([(doc, text)], [x for x in items if x[0] in near])}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted({d for d, _ in rows} - hit)
    sizes = Counter()
    for r in clean.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    goal, taken = brute_targets(sizes), Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
    longest = max(len((r["text"] or "").split()) for r in clean.collect())
    assert all(abs(taken[s] - goal[s]) <= longest for s in goal)
    assert Counter(r["doc_id"] for r in tokens.collect()) == Counter(r["doc_id"] for r in mixed.collect())


def test_pipeline_stages_on_rows_that_are_no_files(spark, documents, edges):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[1:]:
        made = documents(edges)
        out = stage(spark, made, sf)
        assert out.count() > 0 and (name == "tokens" or out.columns == made.columns)


def test_pipeline_stages_on_odd_rows(spark, documents, edges):
    sf = "/root/testdata/sf0.001"
    for rows in (edges, []):
        docs = stored(documents(rows))
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, sf))
            if name == "toxicity":
                assert out.exceptAll(docs).count() == 0
            if name != "tokens":
                assert out.schema == docs.schema
            docs = out


def test_tokens_follow_the_training_order_over_files_of_unequal_size(spark, documents):
    # later parts are larger, and a scan takes large files first
    rows = [(1000 - i, prose(i, 3 + i * i // 4), None, "abc"[i % 3]) for i in range(90)]
    placed = documents(rows).withColumn("_position", F.lit(1000) - F.col("doc_id"))
    docs = stored(placed.repartitionByRange(6, "_position").sortWithinPartitions("_position").drop("_position"))
    out = corpus_pipeline.write_tokens(spark, docs, None).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [d for d, *_ in rows]


def test_tokens_start_by_the_positions_of_the_mix(spark, documents):
    docs = stored(documents([(i, prose(i, 5 + i * 7 % 300), None, "abcd"[i % 4]) for i in range(200)]).repartition(5))
    rows = numbered(docs, "n")
    mixed = mixing.mix(rows.select(F.col("n").alias("doc_id"), "source", "text")).select(F.col("doc_id").alias("n"), "size", F.explode("passes").alias("p"))
    places = mixed.filter("2 * p.taken >= size").join(rows.select("n", "doc_id"), "n").orderBy("p.position", "n").collect()
    mixed = stored(corpus_pipeline.mix_sources(spark, docs, None))
    tokens = corpus_pipeline.write_tokens(spark, mixed, None).orderBy("start").collect()
    assert [r["doc_id"] for r in tokens] == [r["doc_id"] for r in places]


def test_row_numbers_do_not_depend_on_the_packing_of_files(spark, documents):
    docs = stored(documents([(i, prose(i, 5 + i * 7 % 300)) for i in range(200)]).repartition(5))
    rows, setting, seen = numbered(docs, "n"), "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(setting)
    try:
        for most in ("2k", "1g"):
            spark.conf.set(setting, most)
            seen.append({r["doc_id"]: r["n"] for r in rows.select("doc_id", "n").collect()})
    finally:
        spark.conf.set(setting, before)
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 200


def test_decontamination_of_moved_blocks(spark, documents):
    pick, items, docs = random.Random(11), [], []
    for i, n in enumerate([40, 41, 45, 59, 64, 76, 80, 130, 14, 50, 60]):
        words = [f"w{i}x{k}" for k in range(n)] if i < 9 else prose(70 + i, n).split()
        if i == 9:  # blocks between equal runs of four words move at no cost
            words[10:14] = words[22:26] = words[34:38] = words[0:4]
        items.append((i, " ".join(words)))
        for at in range(17):
            cut = n // 2 + pick.randrange(-4, 5)
            own = [*words[cut:], *words[:cut]]
            if i == 9:
                own = [*words[:4], *words[14:22], *words[:4], *words[4:10], *words[:4], *words[26:]]
            if i % 3 == 2:  # a move inside
                own = [*words[: n // 3], *words[2 * n // 3 :], *words[n // 3 : 2 * n // 3]]
            around = prose(300 + 20 * i + at, 40).split()
            docs.append((100 * i + at, " ".join([*around[:at], *own, *around[at:]])))
        docs.append((100 * i + 50, " ".join(words[: n - n // 5])))  # the document ends inside the item
        docs.append((100 * i + 51, " ".join([*words[n // 2 :], *words[: n // 2 - 1]])))
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.find(documents(docs), frame).collect()}
    want = brute_hits(docs, items)
    assert len(want) > 100 and got == pytest.approx(want)


def test_groups_refuse_a_similarity_that_would_lose_links(spark, documents):
    with pytest.raises(ValueError, match="80"):
        neardup.groups(documents([(1, "a b")]), percent=79)


def family(seed, n, base_words, edits, pool):
    """Texts of one template, each with as many edits from a small pool of replacements."""
    pick, base = random.Random(seed), prose(seed, base_words).split()
    out = []
    for _ in range(n):
        words = list(base)
        for at in pick.sample(range(base_words), edits):
            words[at] = f"pool{pick.randrange(pool)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("words,edits", [(200, 10), (40, 3)])
def test_candidates_of_a_template_family_do_not_grow_with_its_square(spark, documents, monkeypatch, words, edits):
    made = []
    whole = neardup._across
    monkeypatch.setattr(neardup, "_across", lambda *a: made.append(whole(*a).count()) or whole(*a))
    for n in (200, 400, 800):
        rows = list(enumerate(family(5, n, words, edits, 20)))
        neardup.groups(documents(rows), size=5).count()
    assert max(made) <= 800 and made[2] <= 4 * max(made[0], 50)


def test_sketches_and_buckets_lose_no_link_of_small_sets(spark, documents):
    """Pairs of similarity 0.8: four of five shingles, eight of ten, sixteen of twenty, and sets of exactly 0.8 beyond."""
    rows, pick = [], random.Random(8)
    for k in range(1500):
        n = [7, 8, 12, 20, 40][k % 5]  # words; a word more or another last word
        own = [f"w{pick.randrange(10**9)}" for _ in range(n)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own, "z"] if k % 5 == 0 else [*own[:-1], "z"]))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(documents(rows), size=4).collect()}
    sets = [shingle_set(t, 4) for _, t in rows]
    for a in range(0, len(rows), 2):
        x, y = sets[a], sets[a + 1]
        linked = 100 * len(x & y) >= 80 * len(x | y)
        assert (got[a + 1] == a) == linked


def test_windows_and_tiles_as_expressions(spark):
    kinds = [(n, b) for n in (1, 2, 4, 5, 6, 9, 14, 16, 20, 23, 37, 40, 59, 60, 94, 130, 400) for b in (0, 1, 2, 5)]
    frame = spark.createDataFrame([(n, b, [0] * max(n - 4, 1)) for n, b in kinds], "length int, breaks int, shingles array<int>")
    for r in decontam._kind(frame).collect():
        width = decontam.window(r["length"], r["breaks"])
        assert (r["width"], r["needed"]) == (width, decontam.tiles(r["length"], r["breaks"], width))
    assert decontam.tiles(59, 1, 8) == 3 and decontam.tiles(20, 0, 8) == 1
