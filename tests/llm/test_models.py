"""Language-model, quality and toxicity scores, and the pipeline."""

import contextlib
import math
import pathlib
import random
import re
import threading
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline.llm import common, quality, suffix_tree, toxicity
from tallyline.llm.common import labelled_sample, remainder

SLURS = ["brolk", "zintup", "quargel"]


# ---- suffix tree

def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + ["\n"]


@pytest.mark.parametrize("min_share", [2e-6, 0.01])
def test_base_scores(docs, none, odd, corpus, min_share):
    """Words inside the tree and words that are joined add up to the same base score."""
    counts = Counter()
    for i, t in corpus:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words(t))
    total, kinds = sum(counts.values()), len(counts)
    got = {r["id"]: r for r in suffix_tree.score_texts(docs, lambda c: remainder(c, 7) == 2, min_share=min_share).collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        r, ws = got[i], words(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(counts[w] > 0 for w in ws), total, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), rel=1e-9)
        assert r["score"] < 0
    assert suffix_tree.score_texts(none, lambda c: remainder(c, 7) == 2).count() == 0
    assert {r["id"]: r["n_tokens"] for r in suffix_tree.score_texts(odd, lambda c: remainder(c, 7) == 2).collect()} == {None: 6, 5: 15, 6: 1}


@pytest.fixture(scope="module")
def grown():
    """A tree grown from a small text by direct counting."""
    rng, index = random.Random(2), {w: i for i, w in enumerate("a b c d e".split() + ["end"])}
    text = []
    for _ in range(3000):
        text.append("a" if not text else {"a": "b", "b": rng.choice("ac")}.get(text[-1]) or ("d" if text[-2:] == ["b", "c"] and rng.random() < .9 else rng.choice("abcde")))
    ids = np.array([-1, index["end"]] + [index[w] for w in text] + [index["end"]])
    train = np.bincount(ids[2:], minlength=6)
    total = int(train.sum())
    tree = suffix_tree.SuffixTree(np.log10((train + 1) / (total + 6 + 1)), train, total)
    for m in (2, 3, 4):
        runs = tree.runs(ids, m - 1)[-1]
        keys = np.where((np.concatenate(([-1], runs[:-1])) >= 0) & (ids >= 0), np.concatenate(([-1], runs[:-1])) * 6 + ids, -1)
        found, n = np.unique(keys[keys >= 0], return_counts=True)
        tree.grow(found[n >= 2], n[n >= 2])
    return tree, ids, index


def test_states_are_distributions(grown):
    """In every state the known words and the share left for unseen words add up to one."""
    tree, _, index = grown
    unseen = 1 / (tree.total + 6 + 1)
    for context in (["a"], ["b"], ["b", "c"], ["c", "b"], ["a", "b", "c"], ["e", "e", "e"]):
        shares = []
        for word in range(6):
            line = np.array([-1] + [index[w] for w in context] + [word])
            shares.append(10 ** (tree.gains(line, 3)[-1] + tree.root[word]))
        line = np.array([-1] + [index[w] for w in context] + [-1])
        rest = 10 ** tree.gains(line, 3)[-1] * unseen
        assert sum(shares) + rest == pytest.approx(1, abs=1e-9)


def test_contexts_are_retained_by_divergence(grown):
    tree, ids, index = grown
    assert tree.kept[1][index["a"]]  # always followed by b
    b_c = suffix_tree.find(tree.keys[2], np.array([index["b"] * 6 + index["c"]]))[0]
    a_b = suffix_tree.find(tree.keys[2], np.array([index["a"] * 6 + index["b"]]))[0]
    assert tree.kept[2][b_c] and not tree.kept[2][a_b]  # b c foretells d, a b no more than b
    gain = tree.gains(ids, 3)
    assert gain.sum() > 0 and tree.gains(ids, 1).sum() < gain.sum()


def test_held_out_texts_score_better_than_words_alone(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["new york city", "hot dog stand", "a b", "red", "blue"]) for _ in range(40))) for i in range(120)]
    got = suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), lambda c: remainder(c, 7) == 2).filter("held_out").collect()
    assert got and all(r["score"] > r["base_score"] for r in got)


@pytest.mark.parametrize("min_share", [2e-6, 0.01, 1.0])
def test_scores_are_those_of_the_whole_tree(spark, min_share):
    """Whatever the share from which runs are broadcast, scores equal those of the tree of all runs seen twice."""
    rng, phrases = random.Random(5), ["new york city hall", "hot and cold", "salt and pepper", "cats and dogs", "a b", "red", "blue", "very rare words here now"]
    rows = [(i, " ".join(rng.choice(phrases if i % 10 == 0 else phrases[:7]) for _ in range(rng.randint(0, 25)))) for i in range(150)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    lines = {i: ["\n", *words(t)] for i, t in rows}
    counts = Counter(w for i, line in lines.items() if i not in held for w in line[1:])
    index = {w: n for n, w in enumerate(counts)}
    train = np.array([counts[w] for w in index])
    total, width = int(train.sum()), len(index)
    tree = suffix_tree.SuffixTree(np.log10((train + 1) / (total + width + 1)), train, total)
    laid = {i: np.array([-1] + [index.get(w, -1) for w in line]) for i, line in lines.items()}
    for m in (2, 3, 4):
        keys = Counter()
        for i in laid.keys() - held:
            before, ids = np.concatenate(([-1], tree.runs(laid[i], m - 1)[-1][:-1])), laid[i]
            keys.update((before * width + ids)[(before >= 0) & (ids >= 0)].tolist())
        keys = {k: n for k, n in keys.items() if n >= 2}
        tree.grow(np.array(list(keys), np.int64), np.array(list(keys.values()), np.int64))
    assert sum(tree.kept[1]) > 5 and sum(tree.kept[2]) > 0
    got = suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), lambda c: remainder(c, 7) == 2, min_share=min_share).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] - r["base_score"] == pytest.approx(tree.gains(laid[r["id"]], 3)[2:].sum(), abs=1e-8)


def test_split_branches_score_alike(spark, monkeypatch):
    """Scores do not depend on whether branches are split, on who gets their pairs, or on the size of blocks and pieces."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["new york city hall", "hot and cold", "a b", "red", "a b", "a red b"]) for _ in range(rng.randint(0, 25)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def scores(**parameters):
        return {r["id"]: r["score"] for r in suffix_tree.score_texts(docs, lambda c: remainder(c, 7) == 2, **parameters).collect()}

    whole = scores()
    monkeypatch.setattr(suffix_tree, "TOLD", 0)
    monkeypatch.setattr(suffix_tree, "PIECE", 50)
    assert scores(min_share=0.02) == pytest.approx(whole, abs=1e-8)


def test_scores_need_little_disk(spark, tmp_path):
    """A text moves in few bytes a word: not every run of words of every text is written and shuffled (some 86 bytes a word before)."""
    rng, known = random.Random(8), [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(known, k=1000))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "docs"))
    folders = [*spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), re.sub("^file:", "", spark.sparkContext.getCheckpointDir() or str(tmp_path / "none"))]
    most, over = [], threading.Event()

    def used():
        found = (p for folder in folders for p in pathlib.Path(folder).rglob("*") if re.search(r"shuffle_|part-", p.name))
        total = 0
        for p in found:
            with contextlib.suppress(OSError):
                total += p.stat().st_size
        return total

    def watch():
        while not over.wait(0.1):
            most.append(used())

    before = used()
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert suffix_tree.score_texts(spark.read.parquet(str(tmp_path / "docs")), lambda c: remainder(c, 7) == 2).count() == 400
    finally:
        over.set()
        watcher.join()
    assert max(most) - before < 40 * 400_000


# ---- labels

def test_labelled_sample(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 0), (99_999, 1)], "doc_id long, toxic int")
    got = sorted((r["id"], r["label"]) for r in labelled_sample(docs, labels, "toxic", lambda c: c >= 0, 100).collect())
    assert got == [(0, 1), (2, 0)]
    assert labelled_sample(docs, labels, "toxic", lambda c: c >= 0, 1).count() <= 1


def prose(rng, n=40):
    return " ".join("".join(rng.choice(["ba", "ne", "ti", "so", "mar", "lu", "ki"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


# ---- quality

@pytest.fixture(scope="module")
def graded(spark):
    rng, rows, labels = random.Random(8), [], []
    for i in range(600):
        good = rng.random() < 0.8
        text = prose(rng)
        if not good:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " | ".join(t.split()), lambda t: " ".join([t.split()[0]] * 40), lambda t: t.replace(" ", "%%% ")])(text)
        rows.append((i, text))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_quality(graded, none, odd, docs):
    frame, labels, truth = graded
    model = quality.fit_labels(frame, labels, lambda c: remainder(c, 5) != 0)
    scores = {r["id"]: r["score"] for r in quality.quality(frame, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and sum((scores[i] >= 0.3) == bool(truth[i]) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in scores.values())
    assert quality.quality(none, model).count() == 0 and quality.quality(odd, model).count() == odd.count()
    assert quality.quality(docs, model).filter("score IS NULL OR isnan(score)").count() == 0


def test_quality_without_two_classes(graded, none):
    frame, labels, _ = graded
    for some in (labels.filter("quality = 1"), labels.filter("quality = 7")):
        model = quality.fit_labels(frame, some, lambda c: c >= 0)
        assert quality.quality(frame.limit(3), model).filter("score >= 0.5").count() == 3


def test_quality_reads_the_whole_of_long_tokens(spark):
    """Texts without blanks that differ only far behind their beginning have different features, shapes and scores."""
    assert quality.shape("a1" * 20 + "-") != quality.shape("a1" * 20 + "!")
    rng, head = random.Random(3), "x1" * 60
    rows = [(i, head + "".join(rng.choice("漢字文書記" if i % 2 else "%#9Aq") for _ in range(200))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit_labels(frame, labels, lambda c: remainder(c, 5) != 0)
    scores = {r["id"]: r["score"] for r in quality.quality(frame, model).collect()}
    assert all((scores[i] >= 0.5) == bool(i % 2) for i in scores if zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality_treats_all_lengths_alike():
    """A character more at the end changes the last piece alone, at 64 characters as anywhere."""
    token = "Ab3" * 50
    assert quality.cut("") == [] and quality.cut("short words") == ["short", "words"]
    for n in range(1, 149):
        now, more = quality.cut(token[:n]), quality.cut(token[:n + 1])
        assert "".join(now) == token[:n] and now[:len(more) - 1] == more[:-1] and {len(p) for p in more[:-1]} <= {quality.PIECE}


def test_unfinished_fits_raise():
    rows, values = [np.arange(2, dtype=np.int32)] * 40, list(np.random.default_rng(4).normal(size=(40, 2)))
    labels = np.arange(40) % 2
    with pytest.raises(ArithmeticError):
        quality.dual_coordinate_descent(rows, values, labels, epochs=1, tolerance=1e-12)
    w, b = quality.dual_coordinate_descent(rows, values, labels)
    assert np.isfinite(w).all() and np.isfinite(b)


def test_logistic_map_at_its_optimum():
    rng = np.random.default_rng(2)
    for margins in (rng.normal(size=60) * 3, np.arange(60) - 30.0, np.zeros(60), rng.normal(size=60) * 1e3):
        labels = (margins + rng.normal(size=60) > 0).astype(int)
        slope, shift = quality.logistic_map(margins, labels)
        n = labels.sum()
        target = np.where(labels > 0, (n + 1) / (n + 2), 1 / (60 - n + 2))
        left = target - 1 / (1 + np.exp(-np.clip(slope * margins + shift, -700, 700)))
        assert abs(left @ margins - 1e-3 * slope) < 1e-3 * (1 + np.abs(margins).sum()) and abs(left.sum() - 1e-3 * shift) < 1e-3


def test_decoding_of_long_runs_is_linear():
    model = toxicity.CharModel([(a, b, 3) for a, b in toxicity.CharModel.grams("trash")])
    took = []
    for n in (4_000, 32_000):
        begin = time.process_time()
        assert set(toxicity.decode(("t r 4 s h " * n)[:n], model))
        took.append(time.process_time() - begin)
    assert took[1] < 24 * took[0]


def test_dual_coordinate_descent():
    """At the optimum no margin row is wrongly bounded: the duality gap closes."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5))
    labels = (x @ [1, -2, 0.5, 0, 1] + rng.normal(size=80) * 0.5 > 0).astype(int)
    rows, values = [np.arange(5, dtype=np.int32)] * 80, list(x)
    w, b = quality.dual_coordinate_descent(rows, values, labels, epochs=2000, tolerance=1e-6)
    y = np.where(labels > 0, 1.0, -1.0)
    primal = lambda v, c: 0.5 * (v @ v + c * c) + np.maximum(0, 1 - y * (x @ v + c)).sum()
    best = primal(w[:5], b)
    for _ in range(300):
        assert primal(w[:5] + rng.normal(size=5) * 0.02, b + rng.normal() * 0.02) >= best - 1e-6


# ---- toxicity

@pytest.fixture(scope="module")
def judged(spark):
    rng, rows, labels = random.Random(9), [], []
    for i in range(700):
        bad = rng.random() < 0.2
        tokens = prose(rng).split()
        if bad:
            for _ in range(3):
                tokens.insert(rng.randrange(len(tokens)), rng.choice(SLURS))
        rows.append((i, " ".join(tokens)))
        labels.append((i, int(bad)))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return frame, marks, dict(labels), toxicity.fit_labels(frame, marks, lambda c: remainder(c, 4) != 2)


def test_toxicity(judged, none, odd, docs):
    frame, _, truth, model = judged
    scores = {r["id"]: r["score"] for r in toxicity.toxicity(frame, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and all((scores[i] >= 0.3) == bool(truth[i]) for i in held)
    mild = toxicity.keep_mild(frame.withColumn("score", F.lit("x")), model)
    assert mild.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in mild.collect()} == {i for i in truth if scores[i] < 0.3}
    assert toxicity.toxicity(none, model).count() == 0 and toxicity.keep_mild(none, model).count() == 0
    assert toxicity.toxicity(odd, model).count() == odd.count() and toxicity.keep_mild(docs, model).columns == docs.columns


@pytest.mark.parametrize("written", ["8r0lk", "b.r.o.l.k", "b r o l k", "brooolk", "BROLK!!", "z1ntup", "zzzintttup", "q-u-a-r-g-e-l", "qu@rge|", "(brolk)", "Z 1 N T U P", "brolk%%%"])
def test_disguised_words(judged, written):
    model = judged[3]
    assert model.score(f"ba ne tiso {written} lu maki") >= 0.3
    found = {f.rstrip("$") for f in model.reader().found(f"ba ne {written} lu")}
    assert any(s.startswith(f) for s in SLURS for f in found)


@pytest.mark.parametrize("text", ["", "a b c d e f", "1 2 3 4", "b r e a d", "4668656817506359", "x" * 5000, "y " * 3000, "... !!! $$$", "bro ban"])
def test_clean_texts(judged, text):
    assert judged[3].score(text) < 0.3


def test_families(spark):
    """One word of a family says nothing where two different ones are toxic; repeats of a word are one word."""
    rng, ends = random.Random(12), "ba ne ti so mar lu ki do fe gu".split()
    rows, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        kin = rng.sample(ends, rng.randint(2, 4) if bad else rng.randint(0, 1))
        tokens = prose(rng).split() + ["vorrel" + e for e in kin] + ["vorrel" + e for e in kin[:1]]
        rng.shuffle(tokens)
        rows.append((i, " ".join(tokens)))
        labels.append((i, int(bad)))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_labels(frame, marks, lambda c: remainder(c, 4) != 2)
    assert any(f.endswith("+") and "vorrel".startswith(f[:-1]) for f in model.weights)
    scores = {r["id"]: r["score"] for r in toxicity.toxicity(frame, model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((scores[i] >= 0.3) == (i % 5 == 0) for i in held)
    assert model.score("ba vorrelne vorrelne! soti") < 0.3 <= model.score("ba vorrelne soti VORRELKI!")
    assert sorted(toxicity.families(["abcd", "abce", "abc", "xyz"])) == ["abc+"] and toxicity.families([]) == []


def test_weights_are_at_their_optimum():
    rng = random.Random(13)
    held = [sorted(rng.sample(range(5), rng.randint(0, 3))) for _ in range(200)]
    y = np.array([float(rng.random() < (0.9 if 4 in h else 0.1 + 0.2 * len(h))) for h in held])
    weights = np.array([2.0, 1.0, 3.0, 2.5, 0.5])
    adds, shift = toxicity.logistic(held, y, weights)
    design = np.array([[float(f in h) for f in range(5)] for h in held] + [[0.0] * 5] * 2)
    labels, counts = np.append(y, [0.0, 1.0]), np.append(np.ones(200), [0.5, 0.5])

    def loss(own, slope, moved):
        z = design @ (slope * weights + own) + moved
        return counts @ (np.logaddexp(0, z) - labels * z) + 0.5 * (own @ own + 1e-3 * (slope ** 2 + moved ** 2))

    # The best split of what a feature adds between the slope and its own part.
    slope = (weights @ adds) / (weights @ weights + 1e-3)
    best = loss(adds - slope * weights, slope, shift)
    steps = np.random.default_rng(1)
    for _ in range(300):
        own, moved = adds - slope * weights + steps.normal(size=5) * 0.02, shift + steps.normal() * 0.02
        assert loss(own, slope + steps.normal() * 0.02, moved) >= best - 1e-9
    adds, shift = toxicity.logistic([[], []], np.array([0.0, 1.0]), np.zeros(0))
    assert len(adds) == 0 and abs(shift) < 1e-6


def test_restored(judged):
    model = judged[3].reader().model
    assert toxicity.restored("the 8r0lk and z i n t u p", model).endswith("zintup") and "brolk" in toxicity.restored("the 8r0lk", model)


def test_decoder_is_exact(judged):
    """The decoder's reading is the likeliest of all readings, listed by brute force."""
    model = judged[3].reader().model

    def readings(written, last="", before=""):
        if not written:
            yield "", 0.0
            return
        c = written[0]
        options = [(c, 0.0)] if c.isalpha() else []
        options += [(x, toxicity.LOOKALIKE) for x in toxicity.LOOKALIKES.get(c, "")]
        for letter, cost in options:
            for rest, p in readings(written[1:], letter, c):
                yield letter + rest, cost + p
            if c == before and letter == last:
                for rest, p in readings(written[1:], last, c):
                    yield rest, toxicity.REPEAT + p
        if not c.isalpha():
            for rest, p in readings(written[1:], last, c):
                yield rest, (toxicity.MARK if options else 0.0) + p

    def log(word):
        line = f"^{word}$"
        return sum(model.log(line[max(0, i - toxicity.ORDER + 1):i], line[i]) for i in range(1, len(line)))

    for written in ("b1ba", "ll1k", "s0-o", "8rrol", "m@@r", "ne!"):
        best = max(p + log(word) for word, p in readings(written) if word)
        (word,) = toxicity.decode(written, model)
        assert max(p + log(w) for w, p in readings(written) if w == word) == pytest.approx(best)


def test_toxicity_without_labels(judged, none):
    frame, marks = judged[:2]
    model = toxicity.fit_labels(frame, marks.filter("toxic = 9"), lambda c: c >= 0)
    assert {r["score"] for r in toxicity.toxicity(frame.limit(5), model).collect()} == {0.5}


def test_rarer_toxic_words_beside_common_ones_are_learned(spark):
    """A pure toxic word counts by itself, however common its company; words of near copies of one toxic text do not."""
    rng, rows, labels = random.Random(12), [], []
    copied = prose(rng, 60) + " " + " ".join(["onlyhere"] * 2)
    for i in range(1200):
        tokens, bad = prose(rng).split(), i < 260
        if bad:
            tokens[3] = SLURS[i % 2]
            if i % 8 == 0:
                tokens[20] = "quargel"
        rows.append((i, " ".join(tokens) if i < 1170 else f"{copied} brolk {i}"))
        labels.append((i, int(bad or i >= 1170)))
    model = toxicity.fit_labels(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), lambda c: c >= 0)
    assert model.score("ba ne tiso quargel lu maki") >= 0.3
    assert not any(f.startswith("onlyh") for f in model.weights) and model.score("ba ne onlyhere lu") < 0.3


@pytest.fixture(scope="module")
def reader():
    grams = Counter(g for w, n in (("ass", 60), ("trash", 60), ("idiot", 60), ("bane", 200), ("soti", 200)) for g in toxicity.CharModel.grams(w) for _ in range(n))
    return toxicity.Reader({"ass$": 5.0, "trash$": 5.0, "idiot$": 5.0}, toxicity.CharModel([(*g, n) for g, n in grams.items()]))


@pytest.mark.parametrize("written", ["a s s", "t!r!a!$!h", "455", "4$$", "i     d    i     o     t", '"i d i o t"', "(t r a s h)", "id iot", "tra sh", "1d i0t", '"id - iot"'])
def test_disguises_beside_the_plain_ones(reader, written):
    assert reader.found(f"bane {written} soti")


@pytest.mark.parametrize("written", ["b a n e", "bane soti", "as bane", "12 34 56 78", "- " * 500, "! " * 500, "1 " * 2000, "tra bane sh"])
def test_other_runs_stay_clean(reader, written):
    assert not reader.found(f"bane {written} soti")


# ---- pipeline

def test_pipeline(spark, tmp_path, judged):
    """Every stage works on what its predecessor kept; planted cases go, clean documents stay."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    frame, marks, truth, model = judged
    item = " ".join(f"item{i} word" for i in range(20))
    more = [(1000, "unique alpha beta gamma delta epsilon"), (1001, "unique  alpha beta gamma delta epsilon"), (1002, item + " tail"), (1003, "plain text of its own here"),
            (1004, "Plain TEXT of its own here"), (1005, "8r0lk and z.i.n.t.u.p ba ne"), (1006, None), (1007, " ")]
    docs = frame.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks.withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
    mild = {i for i in truth if not truth[i]} | {1000, 1001, 1002, 1003, 1004, 1006, 1007}
    assert kept[0] == mild
    assert kept[1] == mild - {1000, 1006}  # the copy with one blank more stays; of the empty texts the longer one
    assert kept[2] <= kept[1] - {1004} and kept[2] >= kept[1] - {1004} - set(truth)
    assert kept[3] == kept[2] - {1002}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == kept[3]
    assert sum(r["length"] for r in rows) <= 4096 * len({r["sequence_id"] for r in rows})


def test_all_labelled_texts_are_learned_from(spark, monkeypatch):
    """A word that only the last of many labelled texts hold is learned; a large group of near copies counts once, in however many tasks."""
    rng, rows, labels = random.Random(14), [], []
    copied = prose(rng, 60) + " onlyhere onlyhere"
    for i in range(9_400):
        bad = i % 300 == 7
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) + (" quargel" if bad else "")) if i < 9_000 else (i, f"{copied} brolk {i}"))
        labels.append((i, int(bad or i >= 9_000)))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert labelled_sample(frame, marks, "toxic", lambda c: c >= 0).count() == 9_400
    seen = []
    word_counts = toxicity.word_counts
    monkeypatch.setattr(toxicity, "word_counts", lambda sample, groups: seen.append(groups.agg(F.max("pieces")).first()[0]) or word_counts(sample, groups))
    monkeypatch.setattr(toxicity, "HELD", 500)
    model = toxicity.fit_labels(frame, marks, lambda c: c >= 0)
    assert seen == [2] and {r["word"]: r["toxic"] for r in word_counts(*counted_rows(spark, frame, marks)).filter("word IN ('quargel$', 'onlyhere$')").collect()} == {"quargel$": 30, "onlyhere$": 1}
    assert model.score("ba ne quargel lu") >= 0.3 and model.score("ba ne onlyhere lu") < 0.3


def counted_rows(spark, frame, marks):
    from tallyline.llm.common import stored
    sample = stored(labelled_sample(frame, marks, "toxic", lambda c: c >= 0).withColumn("row", F.monotonically_increasing_id()))
    return sample, toxicity.near_copies(sample)


def test_sums_over_tasks_give_the_same_fit(spark):
    rng = random.Random(15)
    held = [sorted(rng.sample(range(6), rng.randint(0, 3))) for _ in range(300)]
    y = [int(rng.random() < (0.9 if 4 in h else 0.1 + 0.2 * len(h))) for h in held]
    weights = np.array([2.0, 1.0, 3.0, 2.5, 0.5, 1.5])
    adds, shift = toxicity.logistic(held, np.array(y, float), weights)
    sets = Counter((tuple(h), v) for h, v in zip(held, y))
    table = spark.createDataFrame([(list(h), v, n) for (h, v), n in sets.items()], "found array<int>, y int, times long").repartition(3)
    spread, moved = toxicity.logistic_sets(table, weights)
    assert spread == pytest.approx(adds, abs=1e-8) and moved == pytest.approx(shift, abs=1e-8)


@pytest.mark.parametrize("stretch, together", [(2_000, 256), (7, 3)])
def test_features_are_counted_once_a_group(spark, monkeypatch, stretch, together):
    """Counts by stretches of rows are those of every text by itself, wherever a stretch ends within a group."""
    rng = random.Random(21)
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    texts = [" ".join(rng.choice(["gamba", "gambado", "Gamba,", "gam", "lu", "lumen", "42", "lumens"]) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    rows = [(i, t, rng.randint(0, 1)) for i, t in enumerate(texts)]
    label = {i: i // 10 * 10 for i in range(0, 40)}
    sample = spark.createDataFrame(rows, "row long, text string, label int").repartition(3)
    groups = spark.createDataFrame([(i, c, -(-10 // together), 10) for i, c in label.items()], "node long, copies long, pieces int, size long")
    held: dict[str, set] = {}
    times = Counter()
    for i, text, bad in rows:
        words = [w for w in (toxicity.trimmed(t) for t in text.lower().split()) if w.isalpha()]
        times.update(w + "$" for w in words)
        for f in {f for w in words for f in toxicity.features(w)} | set(toxicity.families(set(words))):
            held.setdefault(f, set()).add((label.get(i, i), bad))
    want = {f: (sum(b for _, b in of), sum(1 - b for _, b in of), times[f]) for f, of in held.items()}
    assert {r["word"]: (r["toxic"], r["clean"], r["times"]) for r in toxicity.word_counts(sample, groups).collect()} == want


def test_no_reading_is_missed_by_the_first_letters():
    """Only tokens are passed over that the spellings cannot read either."""
    spellings = toxicity.Spellings(["clown$", "bomente+", "as$", "ass", "réeux+", "idiot$"])
    rng = random.Random(3)
    opened = passed = 0
    for _ in range(20_000):
        token = "".join(rng.choice("clownbmetasréuxidz140@$!|(-.#²ß5") for _ in range(rng.randint(1, 7)))
        can = spellings.whole_or_begun(token) or bool(spellings.onward(0, token)[0])
        assert not can or spellings.may_open(token)
        opened, passed = opened + can, passed + (not spellings.may_open(token))
    assert opened > 500 and passed > 5_000


def test_few_rows_without_a_label_move(spark):
    frame = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1_500).alias("text"))
    frame = frame.unionByName(spark.createDataFrame([(None, "text 3"), (3, "text 3"), (3, "other"), (7, None)], "doc_id long, text string"))
    marks = spark.createDataFrame([(i, i % 2) for i in range(0, 2_000, 40)] + [(3, 0), (3, 1), (7, 1), (None, 1), (9, None), (-5, 1)], "doc_id long, toxic int")
    wanted = marks.filter("doc_id IS NOT NULL")
    among = [r["doc_id"] for r in common.may_be_among(frame, "doc_id", wanted, "doc_id").collect()]
    ids = {r["doc_id"] for r in wanted.collect()}
    assert sorted(i for i in among if i in ids) == sorted(r["doc_id"] for r in frame.collect() if r["doc_id"] in ids)
    assert len(among) < 1_000
    text = marks.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert common.may_be_among(frame, "doc_id", text, "doc_id").count() == frame.count()
    labels = {}
    for i, label in ((r["doc_id"], r["toxic"]) for r in marks.collect() if r["doc_id"] is not None and r["toxic"] is not None):
        labels[i] = max(label, labels.get(i, 0))
    least = {}
    for i, words in ((r["doc_id"], r["text"] or "") for r in frame.collect()):
        if i in labels:
            least[words] = min(i, least.get(words, i))
    for asked in (marks, text):
        got = labelled_sample(frame, asked, "toxic", lambda c: F.coalesce(c.cast("string"), F.lit("")) >= "")
        assert sorted(map(tuple, got.collect())) == sorted((i, words, labels[i]) for words, i in least.items())


def test_gram_counts():
    words, times = ["trash", "aa", "aa", "é", "字字字字字字", "^", "𝒳y"], [3, 1, 4, 1, 5, 9, 2]
    want = Counter()
    for word, n in zip(words, times):
        for gram in toxicity.CharModel.grams(word):
            want[gram] += n
    got = [(g, n) for contexts, follows, counts in toxicity.gram_counts([w + "$" for w in words], np.array(times)) for *g, n in zip(contexts, follows, counts.tolist())]
    assert len(got) == len(want) and {tuple(g): n for g, n in got} == dict(want)
    assert list(toxicity.gram_counts([], np.zeros(0, np.int64)))[0][0] == []


def test_words_off_the_lexicon_are_not_looked_at():
    reader = toxicity.Reader({"trash$": 5.0, "idi": 4.0}, toxicity.CharModel([(*g, 3) for w in ("trash", "idiot") for g in toxicity.CharModel.grams(w)]))
    assert reader.found("wordy " * 50 + "other words, that; go nowhere. über") == set()
    assert not dict(reader) and not reader.looks
    for text, want in (("so tr ash now", {"trash$"}), ("a t r a s h b", {"trash$"}), ("tras h", {"trash$"}), ("words 1d!0t words", {"idi"}), ("'Trash!!! it", {"trash$"}), ("t. r. a. s. h", {"trash$"})):
        assert reader.found(text) == want, text


def test_the_character_model_stays_packed():
    grams = [(*g, 2) for g in toxicity.CharModel.grams("trash")]
    model = toxicity.CharModel(grams)
    assert not model.seen and model.contexts.dtype.itemsize == 4 * (toxicity.ORDER - 1)
    table = pa.table({"context": [g[0] for g in grams], "follows": [g[1] for g in grams], "n": [g[2] for g in grams]})
    assert toxicity.CharModel(table).share("^tr", "a") == model.share("^tr", "a") > 0.5
    assert toxicity.CharModel([]).share("ab", "c") == 1 / 1_114_112
