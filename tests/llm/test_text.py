"""Decontamination, packing, chat formatting and pseudonyms."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyline.llm import chat, pii
from tallyline.llm.decontaminate import contamination, keep_clean, spans, words_of
from tallyline.llm.packing import Plan, _Lengths, pack_documents, pack_histogram, packed, reduced, sequences, token_pieces

tokenizers = pytest.importorskip("public_tokenizers")


# ---- decontamination

def brute_hits(text, items, size):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, met = set(), set()
    for item, body in items:
        theirs = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        if not theirs or item is None:
            continue
        k = min(size, len(theirs))
        grams = {tuple(theirs[i:i + k]) for i in range(len(theirs) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i:i + k]) in grams:
                hit.update(range(i, i + k))
                met.add(str(item))
    return len(words), len(hit), sorted(met)


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("aa bb cc dd é1 ñ".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(30)] + [(30, None), (31, "One two"), (31, "three four"), (None, "aa bb cc"), (40, "...")]
    texts = [(i, rng.choice([" ", "-", ", "]).join(word().upper() if rng.random() < .3 else word() for _ in range(rng.randint(0, 200)))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "xx ONE, two! yy three  four"), (62, "one two"), (None, items[3][1])]
    return (items, texts, spark.createDataFrame(items, "item_id long, text string"),
            spark.createDataFrame(texts, "doc_id long, text string").withColumns({"item_id": F.lit(1), "ranges": F.lit("x"), "Items": F.lit("y")}))


@pytest.mark.parametrize("size,block_chars", [(3, 10_000), (5, 200)])
def test_contamination(bench, size, block_chars):
    items, texts, item_rows, docs = bench
    got = sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in contamination(docs, item_rows, size=size, block_chars=block_chars).collect()), key=str)
    assert got == sorted(((i, *brute_hits(t, items, size)) for i, t in texts), key=str)
    clean = keep_clean(docs, item_rows, size=size, share=0.05, block_chars=block_chars)
    assert clean.columns == docs.columns
    want = [i for i, t in texts if (lambda w, h, _: h == 0 or 20 * h < w)(*brute_hits(t, items, size))]
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted(want, key=str)


def test_spans_point_into_the_original(bench, none):
    _, _, item_rows, docs = bench
    for r in contamination(docs.filter("doc_id = 62"), item_rows).collect():
        text = "xx ONE, two! yy three  four" if r["n_words"] == 6 else "one two"
        assert [text[s["start"]:s["end"]] for s in r["spans"]] == (["ONE, two", "three  four"] if r["n_words"] == 6 else ["one two"])
    assert spans("Ünï ONE", [(1, 2)]) == [(4, 7)] and words_of("Ünï ONE") == ["Ünï".encode(), b"one"]
    assert contamination(none, item_rows).count() == 0 and contamination(docs, item_rows.filter("item_id < 0")).filter("n_hit > 0").count() == 0


# ---- packing

def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {room: k for k, room in enumerate(bins)}.values():
            if bins[b] + items[i] <= capacity:
                place(i + 1, bins[:b] + [bins[b] + items[i]] + bins[b + 1:])
        place(i + 1, bins + [items[i]])
    place(0, [])
    return best[0] if items else 0


def test_reduction_keeps_the_fewest_bins():
    rng, over = random.Random(5), 0
    for _ in range(600):
        capacity = rng.choice([10, 17, 31])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {k: items.count(k) for k in items}
        plan, left = Plan(capacity), _Lengths(counts)
        reduced(left, capacity, plan)
        assert plan.bins + fewest([k for k, n in left.count.items() for _ in range(n)], capacity) == fewest(items, capacity)
        over += pack_histogram(counts, capacity).bins - fewest(items, capacity)
    assert over <= 3


def test_plan_size_does_not_grow_with_the_corpus():
    rng = random.Random(2)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(4096, int(rng.lognormvariate(6.5, 1.2)) + 1)] += 1
    small, large = (pack_histogram({k: n * f for k, n in counts.items()}, 4096) for f in (1, 10_000))
    assert len(large.slots) < 2 * len(small.slots)
    assert large.bins <= 1.01 * sum(k * n for k, n in counts.items()) * 10_000 / 4096


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_documents(spark, docs, none, odd, corpus):
    from tokenizers import Tokenizer
    path = tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    want = {}
    for i, text in corpus:
        ids = known.encode(text or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 512)):
            piece = ids[at:at + 512]
            want[i, p] = (at, len(piece), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)), piece)
    rows = pack_documents(docs, path, capacity=512, with_ids=True)
    got = rows.collect()
    assert {(r["id"], r["piece"]): (r["start"], r["length"], r["crc"], r["ids"]) for r in got} == want and len(got) == len(want)
    bins = check_places(got, 512)
    assert bins <= math.ceil(sum(x[1] for x in want.values()) / 512) + 1
    assert sorted(len(r["ids"]) for r in sequences(rows).collect()) == sorted(sum(r["length"] for r in g) for _, g in itertools.groupby(sorted(got, key=lambda r: r["sequence_id"]), key=lambda r: r["sequence_id"]))
    assert pack_documents(none, path).count() == 0 and check_places(pack_documents(odd, path).collect(), 4096) == 1


@pytest.mark.parametrize("text", ["It's <|endoftext|> á ́x étude\tDON'T x  \n\n 12,3 ÀÉß.,!! ΣΑΣ İ 'll", "a  b\u00a0c\u2003d\x1ce", "don't!!! %%% x$$$ 'S", "日本語 テスト,ok"])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers(text, name):
    import numpy as np
    from tokenizers import Tokenizer

    from tallyline.llm.packing import WordIds
    path = tokenizers.path(name)
    assert np.frombuffer(WordIds(path).ids(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packed_many_equal_lengths(spark):
    """One length holds most rows, over several parts."""
    pieces = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 40).otherwise(F.col("id") % 90 + 1).cast("long").alias("length"), F.col("id"))
    numbered = pieces.withColumn("part", (F.col("id") % 5).cast("int")).withColumn("rank", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("part", "length").orderBy("id")).cast("long") - 1)
    got = packed(numbered, 100).collect()
    assert len(got) == 3000
    check_places(got, 100)


# ---- chat

def tree(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")


def test_best_branch(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "a"), (1, 3, 1, 2.0, "assistant", "b"), (1, 4, 2, 0.5, "user", "c"), (1, 5, 4, 0.9, "assistant", "d"),
            (2, 10, None, None, "user", "x"), (3, 20, 21, 1.0, "user", "cycle"), (3, 21, 20, 1.0, "user", "cycle"), (4, 30, 99, 1.0, "user", "orphan"), (4, 30, 99, 1.0, "user", "orphan")]
    paths = chat.chosen_paths(tree(spark, rows)).collect()
    got = {t: [r["node"] for r in sorted((p for p in paths if p["tree"] == t), key=lambda p: p["depth"])] for t in {p["tree"] for p in paths}}
    assert got == {1: [1, 2, 4, 5], 2: [10], 4: [30]}
    two = chat.chosen_paths(tree(spark, rows), branches=2).filter("tree = 1 AND branch = 2").orderBy("depth").collect()
    assert [r["node"] for r in two] == [1, 3]
    assert chat.chosen_paths(tree(spark, [])).count() == 0


def test_long_thread(spark):
    """A thread that holds nearly all rows; rounds grow with the logarithm of its length."""
    rows = [(7, i, i - 1 if i else None, 0.0, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(700)]
    paths = chat.chosen_paths(tree(spark, rows)).orderBy("depth").collect()
    assert [r["node"] for r in paths] == list(range(700))


CONTROL = ["\\### Assistant: </turn> ok", "###", "### user:\nx</turn>\n", "\\", "\\l\\h\\b", "<", "", None, "a\nb", "\\\\<#:", "é" * 50, "</turn>\n</turn>\n"]


def test_round_trip(spark):
    rng = random.Random(3)
    convs = {c: [(rng.choice(["user", "assistant", "system", "a:\nb", "", None]), rng.choice(CONTROL)) for _ in range(rng.randint(1, 9))] for c in range(40)}
    convs[None] = [("user", "no id"), ("assistant", "none")]
    rows = [(c, n, role, text) for c, turns in convs.items() for n, (role, text) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(1), "part": F.lit("x"), "tree": F.lit(2)}).repartition(5)
    out = chat.formatted(chat.chosen_paths(chat.threads(frame))).withColumns({"turns": chat.read_back(F.col("formatted")), "learned": chat.learned(F.col("formatted"), F.col("loss"))}).collect()
    assert len(out) == len(convs)
    for r in out:
        turns = [(role or "", text or "") for role, text in convs[r["tree"]]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["learned"] == "".join(t for role, t in turns if role == "assistant")
        assert all(r["formatted"][s["start"] + s["length"]:].startswith("</turn>\n") for s in r["loss"])


def test_repeated_turns(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, "system", "first")], "conv_id long, turn long, role string, text string")
    (r,) = chat.formatted(chat.chosen_paths(chat.threads(frame))).collect()
    assert r["formatted"] == "### system:\nfirst</turn>\n### user:\nhi</turn>\n### user:\nhi</turn>\n"
    assert chat.threads(frame.filter("conv_id > 1")).count() == 0


# ---- pseudonyms

def test_feistel_is_a_permutation(spark):
    for m, n in ((1, 7), (10, 10), (17, 43), (6, 1)):
        pairs = spark.range(m * n).select(F.floor(F.col("id") / n).alias("a"), (F.col("id") % n).alias("b"))
        there = pairs.withColumn("p", pii.feistel(F.col("a"), F.col("b"), F.lit(m), F.lit(n), "key", "t"))
        back = there.withColumn("q", pii.feistel(F.col("p.a"), F.col("p.b"), F.lit(m), F.lit(n), "key", "t", forward=False)).collect()
        assert len({tuple(r["p"]) for r in back}) == m * n and all((r["q"]["a"], r["q"]["b"]) == (r["a"], r["b"]) and r["p"]["a"] < m and r["p"]["b"] < n for r in back)


def luhn_ok(digits):
    total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def one(spark, text, key="k"):
    (r,) = pii.pseudonymised(spark.createDataFrame([(1, text)], "doc_id long, text string"), key).collect()
    return r["text"], r["n_found"]


def test_pseudonyms(spark):
    text = ("card 4111 1111 1111 1111, again 4111-1111-1111-1111; not 4111111111111112. ip 10.0.0.255 not 10.0.0.256. call +1 (434) 555-2368 or (434) 555-2368."
            " ssn 123-45-6789 not 666-45-6789. on 2021-02-28, 28.02.2021; never 2021-02-30. mail Ann.b+9@Mail.example.com and ann.b+9@mail.example.org")
    out, n = one(spark, text)
    assert n == 10 and out == one(spark, text)[0] and out != one(spark, text, "other")[0]
    cards = re.findall(r"card (\d{4} \d{4} \d{4} \d{4}), again (\d{4}-\d{4}-\d{4}-\d{4}); not 4111111111111112", out)[0]
    assert re.sub(r"\D", "", cards[0]) == re.sub(r"\D", "", cards[1]) != "4111111111111111" and luhn_ok(re.sub(r"\D", "", cards[0]))
    address = re.search(r"ip (\d+)\.(\d+)\.(\d+)\.(\d+) not 10\.0\.0\.256", out)
    assert all(int(o) < 256 for o in address.groups()) and "10.0.0.255" not in out
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \(\d{3}\) \d{3}-\d{4}\.", out) and "555-2368" not in out
    assert re.search(r"ssn \d{3}-\d{2}-\d{4} not 666-45-6789", out) and "123-45-6789" not in out
    iso, german = re.search(r"on (\d{4}-\d{2}-\d{2}), (\d{2}\.\d{2}\.\d{4}); never 2021-02-30", out).groups()
    assert date.fromisoformat(iso) == date(int(german[6:]), int(german[3:5]), int(german[:2])) != date(2021, 2, 28)
    left, right = re.search(r"mail (\S+)@Mail.example.com and (\S+)@mail.example.org", out).groups()
    assert left == right != "ann.b+9" and re.fullmatch(r"[a-z0-9]{3}\.[a-z0-9]\+[a-z0-9]", left)


def test_values_stay_apart(spark):
    """Different values of one kind get different pseudonyms."""
    days = [date.fromordinal(date(1999, 12, 25).toordinal() + i).isoformat() for i in range(400)] + [date(1804, 1, 1 + i).isoformat() for i in range(31)] + ["1804-12-31"]
    numbers = [f"+49 {i:09d}" for i in range(0, 10**9, 3_000_017)] + [f"10.0.{i}.{j}" for i in range(8) for j in range(8)] + [f"{a:03d}-{b:02d}-0001" for a in (1, 665, 667, 899) for b in (1, 99)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(days + numbers)], "doc_id long, text string")
    got = pii.pseudonymised(frame, "k").collect()
    assert all(r["n_found"] == 1 for r in got) and len({r["text"] for r in got}) == len(got)
    for r in got:
        if r["id"] < len(days):
            date.fromisoformat(r["text"])


def test_pseudonyms_leave_the_rest(docs, none, odd, corpus):
    got = {r["id"]: (r["text"], r["n_found"]) for r in pii.pseudonymised(docs, "k").collect()}
    assert got == {i: (t or "", 0) for i, t in corpus}
    assert pii.pseudonymised(none, "k").count() == 0 and pii.pseudonymised(odd, "k").count() == odd.count()
    plan = pii.pseudonymised(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_slash_date_has_its_own(spark):
    """All days of 1900-2099 in every way of writing: as many pseudonyms as dates, one day linked across ways, validity kept."""
    days = spark.range(73_049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    ways = {"iso": "yyyy-MM-dd", "dots": "dd.MM.yyyy", "month": "MM/dd/yyyy", "first": "dd/MM/yyyy"}
    rows = days.select("day", *[F.date_format("day", f).alias(w) for w, f in ways.items()])
    got = rows.select("*", *[pii.pseudonym(F.col(w), "k").alias(f"p_{w}") for w in ways]).collect()
    slashes = {r[w]: r[f"p_{w}"] for r in got for w in ("month", "first")}
    assert len(slashes) == 117_298 and len(set(slashes.values())) == len(slashes)
    for r in got:
        iso = date.fromisoformat(r["p_iso"])
        assert 1900 <= iso.year <= 2099 and r["p_dots"] == iso.strftime("%d.%m.%Y") and r["p_month"] == iso.strftime("%m/%d/%Y")
        assert (iso.day <= 12) == (r["day"].day <= 12)
        if r["day"].day > 12:
            assert r["p_first"] == iso.strftime("%d/%m/%Y")
    assert len({r["p_iso"] for r in got}) == len(got)


def test_other_years(spark):
    days = [date(y, m, d) for y in (*range(1, 120), *range(1880, 1900), *range(2100, 2140), 9996, 9999) for m, d in ((1, 1), (1, 31), (2, 28), (2, 29), (7, 30), (8, 31), (12, 31)) if m != 2 or d != 29 or (y % 4 == 0 and (y % 100 != 0 or y % 400 == 0))]
    frame = spark.createDataFrame([(i, d.isoformat()) for i, d in enumerate(days)], "doc_id long, text string")
    got = [r["text"] for r in pii.pseudonymised(frame, "k").collect()]
    assert len(set(got)) == len(days) and all(not 1900 <= date.fromisoformat(g).year <= 2099 for g in got)
    assert pii.pseudonymised(spark.createDataFrame([(1, "0000-01-01 and 2023-02-29")], "doc_id long, text string"), "k").first()["n_found"] == 0


def test_spellings_of_a_number(spark):
    ways = ["+49301234567", "+49 30 1234567", "+4930 1234567", "+49-30-123-4567", "+49 (30) 1234567"]
    got = [one(spark, w)[0] for w in ways]
    digits = {re.sub(r"\D", "", g) for g in got}
    assert len(digits) == 1 and digits.pop().startswith("49") and [re.sub(r"\d", "0", g) for g in got] == [re.sub(r"\d", "0", w) for w in ways]
    assert all(one(spark, w)[0].startswith(w[:k]) and one(spark, w)[0] != w for w, k in (("+1 434 555 2368", 2), ("+7 495 123 4567", 2), ("+352 621 123 456", 4), ("+420 601 123 456", 4)))


def found_by_hand(text):
    """Spans of valid findings, by plain rules over candidate substrings."""
    out, at = [], 0
    forms = [(k, re.compile(f)) for k, f in pii.FORMS.items()]
    edge = re.compile(r"[\w@.+-]")
    while at < len(text):
        if at and (text[at - 1].isalnum() or text[at - 1] in "@._+-"):
            at += 1
            continue
        for _, form in forms:
            m = form.match(text, at)
            while m and m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "@"):
                m = next((x for e in range(m.end() - 1, at, -1) if (x := form.fullmatch(text, at, e)) and not (text[e].isalnum() or text[e] == "@")), None)
            if m:
                out.append(m[0])
                at = m.end()
                break
        else:
            at += 1
    return out


def valid_by_hand(found):
    digits = re.sub(r"\D", "", found)
    full = {k for k, f in pii.FORMS.items() if re.fullmatch(f, found)}
    if "email" in full and re.search("[A-Za-z0-9]", found.split("@")[0]):
        return True
    if "date" in full:
        y, m, d = (found[:4], found[5:7], found[8:]) if found[:4].isdigit() else (found[6:], found[3:5], found[:2])
        if "/" in found and not found[:4].isdigit() and 1 <= int(found[:2]) <= 12:
            m, d = found[:2], found[3:5]
        try:
            date(int(y), int(m), int(d))
            return True
        except ValueError:
            pass
    if "ip" in full and all(int(o) <= 255 for o in found.split(".")):
        return True
    if "phone" in full and 7 <= len(digits) <= 15:
        return True
    if "ssn" in full and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000":
        return True
    return "card" in full and 13 <= len(digits) and luhn_ok(digits)


def test_finding_against_plain_rules(spark):
    rng = random.Random(12)
    bits = ["4111 1111 1111 1111", "4111111111111112", "10.0.0.1", "300.1.1.1", "2021-02-28", "2021-02-30", "31/12/1999", "12/31/1999", "13/13/2000", "+49 30 1234567", "555-123-4567",
            "(434) 555-2368", "123-45-6789", "666-12-1234", "a.b@c.org", "x@y", "..@d.com", "word", "1234567", "é", "@", ".", "0000-00-00", "a@b.c.d.e.f.g.h.i.j.k.org", "378282246310005"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", ", ", "\n", "", "-", " x"]) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    got = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    for r in got:
        assert r["n_found"] == sum(map(valid_by_hand, found_by_hand(texts[r["id"]]))), texts[r["id"]]


def test_blocks_one_at_a_time_and_ids_of_any_type(spark, bench, monkeypatch):
    """Many blocks: one broadcast lives at once; ids that are dates give the hits that numbers give."""
    from pyspark import SparkContext

    from tallyline.llm import decontaminate
    _, _, items, docs = bench
    dated = items.withColumn("item_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("item_id").cast("int")))
    live, most = [0], [0]

    def counted(self, value, make=SparkContext.broadcast):
        found = make(self, value)
        live[0] += 1
        most[0] = max(most[0], live[0])
        destroy = found.destroy
        found.destroy = lambda *a: (live.__setitem__(0, live[0] - 1), destroy(*a))
        return found

    def hits(rows):
        return sorted(((r["id"], r["n_words"], r["n_hit"], len(r["items"])) for r in rows.collect()), key=str)

    whole = hits(contamination(docs, items, size=5))
    monkeypatch.setattr(SparkContext, "broadcast", counted)
    asked = []
    monkeypatch.setattr(decontaminate, "item_blocks", lambda *a, make=decontaminate.item_blocks: (asked.append(1) or b for b in make(*a)))
    got = hits(contamination(docs, dated, size=5, block_chars=150))
    assert got == whole and len(asked) > 3 and most[0] == 1
