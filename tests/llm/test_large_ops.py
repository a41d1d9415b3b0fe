"""Near duplicates, substring dedup, the two classifiers and the pipeline."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_words import words
from strandsift.llm import chosen_path, components, quality, sentence_spans, toxicity


def brute_groups(texts, width, percent):
    sets = {}
    for k, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_copies(rng, text, n, most):
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_groups_against_all_pairs(spark, make_docs, width, percent):
    rng = random.Random(width)
    texts = [words(rng, rng.randint(1, 80)) for _ in range(150)]
    for _ in range(12):
        texts += near_copies(rng, words(rng, 90), rng.randint(2, 9), 3)
    texts += near_copies(rng, words(rng, 120), 400, 3)  # a group beyond two blocks
    texts += [texts[3]] * 5 + ["", None, "one", "ONE", "one two", "a b c d", " A b\tc D "]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosen_path.groups(make_docs(texts), width, percent).collect()}
    assert got == brute_groups(texts, width, percent)


def grouped(spark, rows):
    n, size = len(rows), sum(len(r[2]) for r in rows)
    return spark.createDataFrame([(1, *r, n, size) for r in rows], "grp long, id long, n long, data binary, size long, bytes long").repartition(3)


def test_blocks_lose_no_link(spark):
    """Chains and pairs inside one large group: the second round must find what block 0 does not reach."""
    n = 700
    rows = [(k, 1, (k if k % 3 else 3 * (k // 9)).to_bytes(4, "little")) for k in range(n)]

    def near_of(ns, data):
        v = np.array([int.from_bytes(d, "little") for d in data])
        return lambda i: v == v[i]

    links = components.spanning_links(grouped(spark, rows), near_of, block=32)
    got = {r.id: r.comp for r in components.connected_components(links).collect()}
    first = {}
    for k, _, d in rows:
        first.setdefault(d, k)
    want = {k: first[d] for k, _, d in rows}
    assert {k: got.get(k, k) for k in range(n)} == want


def brute_components(items, linked):
    root = {k: k for k in items}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(items, 2):
        if linked(items[a], items[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in items}


@pytest.mark.parametrize("block_bytes", [1 << 30, 4000])
def test_blocks_of_sets_lose_no_link(spark, block_bytes):
    """Sets around several templates, many of them just above or below the threshold, of different sizes."""
    r = np.random.default_rng(8)
    sets = {}
    for t in range(3):
        template = r.integers(1, 1 << 62, 60 + 6 * t, dtype=np.uint64)
        for k in range(90):
            own = r.integers(1, 1 << 62, r.integers(0, 9), dtype=np.uint64)
            sets[len(sets)] = np.unique(np.concatenate([r.permutation(template)[r.integers(0, 7) :], own]))
    links = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    want = brute_components(sets, links)
    assert len(set(want.values())) > 20
    rows = [(k, len(s), s.tobytes()) for k, s in sets.items()]
    for prefix in (None, chosen_path._by_prefix(85)):
        out = components.spanning_links(grouped(spark, rows), chosen_path._by_set(85), prefix, block=16, block_bytes=block_bytes)
        got = {x.id: x.comp for x in components.connected_components(out).collect()}
        assert {k: got.get(k, k) for k in sets} == want


@pytest.mark.parametrize("edits", [2, 11])
def test_links_grow_with_the_group(spark, make_docs, edits):
    """Near copies of one text, and pages of one template just below the threshold: as many links a document in groups of any size."""
    rng = random.Random(edits)
    text = words(rng, 200, 10**6)
    each = []
    for n in (600, 1200):
        docs = make_docs(near_copies(rng, text, n, edits) if edits == 2 else ["".join(f"{w}{rng.randrange(10**6)} " if i % 37 == 0 else w + " " for i, w in enumerate(text.split())) for _ in range(n)])
        chosen_path.tuned(spark)
        signed = docs.select("doc_id", F.col("text")).mapInArrow(chosen_path._signed(3), "doc_id bigint, n bigint, h1 bigint, h2 bigint, sig binary").dropDuplicates(["h1", "h2"])
        links = chosen_path._loose_links(signed.select(F.col("doc_id").alias("id"), "n", "sig").cache(), 85)
        each.append(links.distinct().count() / n)
    assert max(each) < 4 and each[1] < 2.5 * each[0]


def test_texts_of_one_id_are_linked(spark):
    rng = random.Random(5)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a), (2, b), (3, a), (3, b), (3, ""), (9, words(rng, 60))]
    got = chosen_path.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 1), (3, 1), (3, 3), (9, 9)]


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 102), (101, 102), (7, 7)], "a long, b long")
    got = {r.id: r.comp for r in components.connected_components(df).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def test_groups_of_odd_rows(spark, odd_docs):
    rows = chosen_path.groups(odd_docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (7, 7)]
    assert chosen_path.groups(odd_docs.limit(0)).count() == 0
    kept = chosen_path.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 7


def plain_sentences(text):
    """[(words in lower case, where the sentence stands in the text)] by a scan of its own."""
    out, words, start = [], [], 0
    stands = [(m.group(), m.start()) for m in re.finditer(r"[^\s]+", text)]
    for k, (w, at) in enumerate(stands):
        words.append(w.lower())
        if re.search(r"[.!?…][\"')\]}»”’]*$", w) or k == len(stands) - 1:
            end = stands[k + 1][1] if k + 1 < len(stands) else len(text)
            out.append((words, start, end))
            words, start = [], end
    return out


def brute_repeats(texts):
    """For texts whose sentences have 12 words at most: runs of two or more sentences and 20 or more words, forward from
    every sentence, and back from each where no such run ends; compared as tuples of words, with no hash and no operator."""
    seen, out = set(), []
    for text in texts:
        sents = plain_sentences(text)
        assert all(len(w) <= 12 for w, _, _ in sents)
        n, size = len(sents), lambda a, z: sum(len(w) for w, _, _ in sents[a:z])  # noqa: B023
        runs = []
        for a in range(n):
            z = next((z for z in range(a + 2, n + 1) if size(a, z) >= 20), None)
            if z:
                runs.append((a, z))
        ends = {z for _, z in runs}
        for z in range(1, n + 1):
            a = next((a for a in range(z - 2, -1, -1) if size(a, z) >= 20), None)
            if z not in ends and a is not None:
                runs.append((a, z))
        words = {(a, z): tuple(w for x, _, _ in sents[a:z] for w in x) for a, z in runs}
        own, gone = {}, set()
        for a, z in sorted(runs, key=lambda r: r[0]):
            key = words[a, z]
            if key in seen:
                gone |= set(range(a, z))
            elif key in own:
                gone |= set(range(max(a, own[key]), z))
            else:
                own[key] = z
        seen |= set(words.values())
        out.append("".join(text[x:y] for i, (_, x, y) in enumerate(sents) if i not in gone).rstrip() if gone else text)
    return out


def sentences(rng, n, most=30):
    return " ".join(words(rng, rng.randint(3, most)).capitalize() + "." for _ in range(n))


def test_repeats_against_a_scan(spark, make_docs, rng):
    passages = [sentences(rng, 6, 12) for _ in range(4)]
    texts = [sentences(rng, rng.randint(0, 9), 12) + "\n" + (rng.choice(passages) + " " if k % 3 == 0 else "") + sentences(rng, 3, 12) for k in range(90)]
    texts += [texts[1], texts[2] + " " + texts[2], ""]
    got = {r.doc_id: r.text for r in sentence_spans.remove_repeats(make_docs(texts)).collect()}
    want = brute_repeats(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert want[-3] == "" and want[1] == texts[1]


def runs_of(cut, text):
    return set(zip(*(x.tolist() for x in cut.spans(text)[:2])))


def test_short_sentences_are_never_divided(rng):
    cut = sentence_spans.Cutter()
    for _ in range(50):
        sizes = [rng.randint(1, 12) for _ in range(20)]
        text = " ".join(words(rng, k) + rng.choice([".", "!", '?"', "…"]) for k in sizes)
        assert cut.pieces(text)[1].tolist() == list(itertools.accumulate(sizes))
    assert len(cut.spans(words(rng, 12) + ".")[0]) == 0
    parts = np.diff(np.concatenate([[0], cut.pieces(words(rng, 400))[1]]))
    assert parts.max() <= 9


def test_passages_of_fifty_words_go_wherever_they_stand(rng):
    cut = sentence_spans.Cutter()
    for _ in range(60):
        passage = " ".join(words(rng, k) + "." for k in (rng.choice([(52,), (25, 27), (9, 13, 31), (20, 20, 12)])))
        first = words(rng, 40) + " " + passage + " " + words(rng, 30)
        second = sentences(rng, 2) + " " + words(rng, 5) + " " + passage + " " + words(rng, 6) + "."
        left = sentence_spans.without(cut, second, runs_of(cut, first))
        gone = len(passage.split()) - sum(w in set(left.split()) for w in passage.split())
        assert gone >= 20


def windows(text, n=50):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("sentence", [0, 8, 15, 25])
def test_no_window_of_a_passage_stays(rng, sentence):
    """A scan of all windows, without the operator's cuts: passages of 50 to 60 words, wrapped anew, in other surroundings."""

    def prose(n):
        return [f"w{rng.randrange(4000)}" + ("." if sentence and rng.randrange(sentence) == 0 else "") for _ in range(n)]

    def wrapped(ws):
        return "".join(w + rng.choice([" ", " ", " ", " ", "\n", "  "]) for w in ws)

    cut = sentence_spans.Cutter()
    left = found = 0
    for k in range(400):
        passage = prose(50 + k % 11)
        first = wrapped([*prose(rng.randint(0, 40)), *passage, *prose(rng.randint(0, 40))])
        second = wrapped([*prose(rng.randint(0, 40)), *passage, *prose(rng.randint(0, 40))])
        assert windows(first) & windows(second)
        out = sentence_spans.without(cut, second, runs_of(cut, first))
        assert not windows(first, 55) & windows(out, 55)
        found += not windows(first) & windows(out)
        left += len(set(passage) & set(out.split())) / len(set(passage))
    assert found >= 398 and left / 400 < 0.2


def test_runs_of_one_word_go():
    cut = sentence_spans.Cutter()
    first = "a start of some words " + "row " * 60 + "and an end"
    out = sentence_spans.without(cut, "quite another start here now " + "row " * 61 + "with yet another end", runs_of(cut, first))
    assert out.split().count("row") < 20


def test_repeats_of_odd_rows(spark, odd_docs):
    out = sentence_spans.remove_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    assert len(rows) == 7 and sum(r.text is None for r in rows) == 1
    assert sentence_spans.remove_repeats(odd_docs.limit(0)).count() == 0


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


HELD = lambda c: F.crc32(c.cast("string")) % 3 == 1


def test_quality_on_held_out_rows(spark, make_docs):
    rng = random.Random(4)
    texts, labels = [], []
    for k in range(600):
        good = rng.random() < 0.6
        t = sentences(rng, 5) if good else rng.choice([" | ".join(words(rng, 30).split()), (words(rng, 1) + " ") * 40, " ".join(w + "$$$" for w in words(rng, 30).split())])
        texts.append(t)
        labels.append((k, int(good), 0))
    out, _ = quality.classify(make_docs(texts), labelled(spark, labels), HELD)
    rows = out.collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 600 and held
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def plain_cut(rows, at, thresholds, least):
    """(gain, threshold) of the best split of ``rows`` = [(values, slope, curvature)] by the value at ``at``, by trying each."""
    score = lambda some: sum(r[1] for r in some) ** 2 / (sum(r[2] for r in some) + 1)
    found = (0.0, None)
    for t in thresholds:
        low, high = [r for r in rows if r[0][at] < t], [r for r in rows if r[0][at] >= t]
        if sum(r[2] for r in low) < least or sum(r[2] for r in high) < least:
            continue
        gain = score(low) + score(high) - score(rows)
        if gain > found[0] + 1e-12:
            found = (gain, t)
    return found


def plain_tree(rows, order, thresholds, least):
    """(gain, value of a row) of a tree that splits by order[0], then by order[1]."""
    gain, t = plain_cut(rows, order[0], thresholds[order[0]], least)
    leaves = []
    for low in (True, False) if t is not None else (None,):
        half = [r for r in rows if low is None or (r[0][order[0]] < t) == low]
        cuts = [u for u in thresholds[order[1]] if low is None or order[0] != order[1] or (u < t if low else u > t)]
        more, m = plain_cut(half, order[1], cuts, least)
        gain += more
        for under in (True, False) if m is not None else (None,):
            leaf = [r for r in half if under is None or (r[0][order[1]] < m) == under]
            leaves.append(((t, low, m, under), -sum(r[1] for r in leaf) / (sum(r[2] for r in leaf) + 1)))

    def value(v):
        for (t, low, m, under), w in leaves:
            if (low is None or (v[order[0]] < t) == low) and (under is None or (v[order[1]] < m) == under):
                return w

    return gain, value


def test_boosting_against_a_plain_version(monkeypatch):
    for name, n in (("ROUNDS", 3), ("PAIR_ROUNDS", 3), ("PAIRS", 1), ("BINS", 8)):
        monkeypatch.setattr(quality, name, n)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3) | (x[:, 1] > 1)).astype(float)
    thresholds = [[float(np.quantile(x[:, j], q / 8)) for q in range(1, 8)] for j in range(3)]
    rate = (y.sum() + 1) / (len(y) + 2)
    f = [float(np.log(rate / (1 - rate)))] * len(y)

    def rows():
        p = [1 / (1 + np.exp(-v)) for v in f]
        return [(tuple(v), a - b, a * (1 - a)) for v, a, b in zip(x.tolist(), p, y.tolist())]

    def add(value):
        for i, v in enumerate(x.tolist()):
            f[i] += quality.RATE * value(v)

    for _ in range(3):
        for j in range(3):
            add(plain_tree(rows(), (j, j), thresholds, 2.0)[1])
    now = rows()
    better = lambda i, j, some: max((plain_tree(some, o, thresholds, 1.0) for o in ((i, j), (j, i))), key=lambda r: r[0])
    pair = max(itertools.combinations(range(3), 2), key=lambda p: better(*p, now)[0])
    for _ in range(3):
        add(better(*pair, rows())[1])
    model = quality.fit(x, y)
    assert model.pairs == [pair] == [(0, 2)]
    assert model.margin(x) == pytest.approx(f, abs=1e-9)
    assert np.ptp(f) > 0.5


def test_interactions_are_learnt():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_classifiers_without_labels_and_on_odd_rows(spark, odd_docs):
    none = labelled(spark, [(1, None, None), (2, 5, 7), (None, 1, 1)])
    rows = quality.classify(odd_docs, none, HELD)[0].collect()
    assert len(rows) == 6 and {r.score for r in rows} == {0.5}
    model = toxicity.train(odd_docs, none, HELD)
    assert len(toxicity.score(odd_docs, model).collect()) == 6
    assert toxicity.score(odd_docs.limit(0), model).count() == 0
    assert toxicity.keep_clean(odd_docs, toxicity.Linear({}, -1.0)).columns == odd_docs.columns


def test_toxicity_on_held_out_rows_and_stems(spark, make_docs):
    rng = random.Random(6)
    texts, labels = [], []
    for k in range(800):
        bad = rng.random() < 0.3
        w = words(rng, 60).split()
        if bad:
            w[rng.randrange(60)] = rng.choice(["snarfol", "snarfing", "snarfed", "grubbo"]) + rng.choice(["", "s", "en"])
        texts.append(" ".join(w))
        labels.append((k, 1, int(bad)))
    docs = make_docs(texts)
    model = toxicity.train(docs, labelled(spark, labels), HELD)
    rows = toxicity.score(docs, model).withColumn("held", HELD(F.col("doc_id"))).where("held").collect()
    assert np.mean([r.predicted == labels[r.doc_id][2] for r in rows]) > 0.97
    assert model.score("he is a snarfery") > 0.5 > model.score("he is a man")


def test_naming_a_group_is_not_toxic():
    """The training rows name women in toxic texts only; the twins keep that from counting."""
    rows = [[0, 1]] * 50 + [[1]] * 10 + [[2]] * 60  # 0: women, 1: an insult, 2: men
    y = np.array([1.0] * 60 + [0.0] * 60)
    plain, _ = toxicity.fit(rows, y, [], 3)
    fair, _ = toxicity.fit(rows, y, [([0], [2], 30)], 3)
    assert abs(fair[0] - fair[2]) < 0.2 * abs(plain[0] - plain[2])
    swaps = toxicity.Swaps()
    assert list(swaps("The women left. nothing here")) == [("the women left", "the boys left"), ("the women left", "the girls left")]
    ((a, b),) = toxicity.Swaps([("x", "y")])("no name in it")
    assert sorted((a, b)) == ["x no name in it", "y no name in it"]
    assert not list(swaps("")) and not list(toxicity.Swaps([])("the women"))


def test_fit_against_a_plain_descent():
    """The same least loss as plain gradient descent finds, on a tiny table."""
    r = np.random.default_rng(5)
    x = (r.random((60, 4)) < 0.4).astype(float)
    y = (r.random(60) < 1 / (1 + np.exp(2 - 3 * x[:, 0] - 2 * x[:, 1]))).astype(float)
    a, b = np.eye(4)[[0, 0, 1]], np.eye(4)[[2, 3, 3]]
    on = lambda m: [np.flatnonzero(v).tolist() for v in m]
    loss = lambda w, c: -np.mean(y * np.log(s(x @ w + c)) + (1 - y) * np.log(1 - s(x @ w + c))) + toxicity.RIDGE / 8 * w @ w + toxicity.TWIN_WEIGHT * np.mean((s(a @ w + c) - s(b @ w + c)) ** 2)
    s = lambda z: 1 / (1 + np.exp(-z))
    v = np.zeros(5)
    for _ in range(4000):
        v -= 0.3 * np.array([(loss((v + e)[:4], (v + e)[4]) - loss((v - e)[:4], (v - e)[4])) / 2e-5 for e in 1e-5 * np.eye(5)])
    w, bias = toxicity.fit(on(x), y, [(p, q, 1) for p, q in zip(on(a), on(b))], 4)
    assert loss(w, bias) < loss(v[:4], v[4]) + 1e-3


def test_neutral_mentions_are_left_alone(spark, make_docs):
    """Labels that name one group in toxic texts mostly: neutral mentions are taken for toxic without the twins, not with them."""
    rng = random.Random(9)
    texts, labels = [], []
    for k in range(600):
        bad = rng.random() < 0.4
        w = words(rng, 30).split()
        if bad:
            w[3] = rng.choice(["snarfol", "grubbo", "zwick"])
        if rng.random() < (0.8 if bad else 0.02):
            w[10] = "muslim"
        elif rng.random() < 0.3:
            w[10] = "christian"
        texts.append(" ".join(w) + ".")
        labels.append((k, 1, int(bad)))
    docs, table = make_docs(texts), labelled(spark, labels)
    none = lambda c: F.lit(False)
    fair, plain = (toxicity.train(docs, table, none, twin_weight=t) for t in (toxicity.TWIN_WEIGHT, 0.0))
    neutral = [words(rng, 12) + " muslim " + words(rng, 12) for _ in range(200)]
    wrong = [np.mean([m.score(t) for t in neutral]) for m in (fair, plain)]
    assert fair.twins >= 600 and wrong[0] < 0.6 * wrong[1]
    assert np.mean([fair.score(t) >= 0.5 for t in neutral]) <= np.mean([plain.score(t) >= 0.5 for t in neutral])
    assert np.mean([(fair.score(t) >= 0.5) == bool(x[2]) for t, x in zip(texts, labels)]) > 0.97


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_tables_give_twins(spark, sf):
    read = lambda t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
    assert toxicity.train(read("documents"), read("labels"), lambda c: F.lit(False)).twins > 0


def test_repeated_and_contradictory_labels_count_once(spark, make_docs):
    docs = make_docs([f"good text {k}" if k % 2 else f"snarf text {k}" for k in range(40)])
    rows = [(k, 1, 1 - k % 2) for k in range(40)]
    once = toxicity.train(docs, labelled(spark, rows), lambda c: F.lit(False))
    more = toxicity.train(docs.union(docs.where("doc_id < 9")), labelled(spark, [*rows, *rows[:9], (100, 1, 0), (100, 1, 1)]), lambda c: F.lit(False))
    assert once.weights == more.weights and once.bias == more.bias


def by_scan(texts):
    """The texts without repeats, document by document, with the operator's cuts but none of its joins."""
    cut, seen, out = sentence_spans.Cutter(), set(), []
    for t in texts:
        own = runs_of(cut, t)
        out.append(sentence_spans.without(cut, t, own & seen))
        seen |= own
    return out


def test_pipeline_runs_stage_by_stage(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "near duplicates", "substring dedup", "mixing", "packing"]
    before = docs.count()
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), lambda c: F.lit(False))
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect() if model.score(r.text) < 0.5}
            assert 0.7 * before < len(rows) < before
        if k == 1:
            texts = {r.doc_id: r.text for r in docs.collect()}
            ids = sorted(texts)
            want = brute_groups([texts[i] for i in ids], 5, 80)
            assert {r.doc_id for r in rows} == {ids[k] for k, (_, c) in want.items() if c == k}
        if k == 2:
            ordered = docs.orderBy("doc_id").collect()
            assert {r.doc_id: r.text for r in rows} == dict(zip([r.doc_id for r in ordered], by_scan([r.text for r in ordered])))
            assert all(r.n_chars == len(r.text) for r in rows)
        if k == 4:
            assert len(rows) == docs.count()
        docs = spark.createDataFrame(rows, out.schema)


def test_stages_on_odd_rows(spark, odd_docs, tmp_path):
    import corpus_pipeline as p

    labels = labelled(spark, [(2, 1, 0), (4, 1, 1), (7, None, None)])
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, odd_docs.limit(0), odd_docs.withColumnRenamed("h", "a.b").withColumn("copy", F.lit("own"))):
        for k, (_, stage) in enumerate(p.STAGES):
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            if k < 4:
                assert out.columns == docs.columns
            if k in (1, 2) and docs.count():
                assert len(rows) == 7
