"""Alignment of two tokenizers and first-fit packing against plain recomputation."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tallyline.llm.align import align, common_ends, most_pairs, ranks  # noqa: E402
from tallyline.llm.first_fit import Tournament, pack_group, pack_padded, token_sequences  # noqa: E402
from tallyline.llm.tokens import ByteBpe  # noqa: E402

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> a<|endoftext|>", "x" * 300, "a\x00b\u0085c d", "naïve 東京 😀 ▁ <0x41> </s>", " lead", "trail  ", "a  b \n c\t\td", "İé́ß…", "don't we'll 123 4567"]


def ids_of(text, plain):
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = plain
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("plain", [False, True])
def test_ids_are_the_library_s(corpus, plain):
    known = ByteBpe(BYTES, plain)
    assert known.quick is not None
    for text in [t or "" for _, t in corpus] + ODD + [" " * 250_000 + "x"]:
        assert known.ids(text).tolist() == ids_of(text, plain)


def test_ranks_and_common_ends():
    rng = np.random.default_rng(3)
    for n, m in [(0, 5), (1, 1), (3, 4000), (700, 900), (500, 500), (4000, 3)]:
        a, b = (np.sort(1 + rng.choice(5999, k, replace=False)) for k in (n, m))
        a, b = (np.append(x, 6000) if len(x) else x for x in (a, b))
        if len(a) <= len(b):
            assert ranks(a, b).tolist() == np.searchsorted(b, a).tolist()
        at_a, at_b, over = common_ends(a, b)
        assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        starts = [0, *long[:-1].tolist()]
        want = [sum(s < x and e > f for s, e in zip(starts, long.tolist())) for f, x in zip([0, *short[:-1].tolist()], short.tolist())] if len(short) * len(long) < 10**6 else None
        assert want is None or over.tolist() == want


def plain_alignment(texts):
    """Groups, links and counts by sets of ends."""
    bytes_a, sp = ByteBpe(BYTES, True).bytes, SentencePieceProcessor(model_file=PIECES)
    found, counts = [], Counter()
    for text in texts:
        a, b = (ids_of(" " + text, True), sp.encode(text)) if text else ([], [])
        ta = [bytes_a[i] for i in a]
        tb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        data = (" " + text).encode() if text else b""
        if not text or b"".join(ta) != data or b"".join(tb) != data:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        groups = []
        for low, high in zip([0, *both], both):
            groups.append(",".join(str(i) for i, e in zip(a, ends_a) if low < e <= high) + "|" + ",".join(str(i) for i, e in zip(b, ends_b) if low < e <= high))
        links = [(i, j) for e in both for i, x in zip(a, ends_a) if x == e for j, y in zip(b, ends_b) if y == e]
        found.append((len(a), len(b), len(both), ";".join(groups), links))
        counts.update(links)
    return found, counts


def test_align(spark, corpus):
    texts = [t for _, t in corpus if t is None or len(t) < 4000] + ODD + [ODD[0]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", F.lit(1).alias("pairs"), F.lit("x").alias("n_a"), F.lit(2).alias("groups"))
    got = {r["id"]: r for r in align(frame.repartition(3), BYTES, PIECES, with_groups=True).collect()}
    want, counts = plain_alignment(texts)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    assert len(counts) <= most_pairs(BYTES, PIECES)
    assert any(w is None for t, w in zip(texts, want) if t)
    for i, w in enumerate(want):
        r = got[i]
        if w is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, "", "", 0, 0)
            continue
        n_a, n_b, n_groups, groups, links = w
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, n_groups, len(links))
        assert r["groups"] == groups and r["groups_sha256"] == hashlib.sha256(groups.encode()).hexdigest()
        assert r["count_sum"] == sum(counts[p] for p in links) and r["n_best"] == sum(counts[p] == most[p[1]] for p in links)


def test_align_empty_and_odd(spark, none, odd):
    assert align(none, BYTES, PIECES).count() == 0
    got = align(odd, BYTES, PIECES).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["n_groups"] > 0) for r in got) == [(False, 5, True)] * 3 + [(False, 6, False), (True, 0, False), (True, 0, True)]


def test_first_fit_is_leftmost():
    rng = random.Random(2)
    tree, plain = Tournament(60, 100), [100] * 60
    for _ in range(60):
        size = rng.randint(1, 100)
        want = next(i for i, room in enumerate(plain) if room >= size)
        plain[want] -= size
        assert tree.first_fit(size) == want


@pytest.mark.parametrize("capacity", [8, 2048])
def test_groups_have_no_padding(capacity):
    rng = random.Random(4)
    for n in [0, 1, 2, 3, 10, 200]:
        for _ in range(20):
            lengths = [rng.randint(1, capacity) for _ in range(n)]
            sequences = pack_group(lengths, capacity)
            places = defaultdict(list)
            for s in sequences:
                total = sum(stop - start for _, start, stop in s)
                assert total == capacity or total & (total - 1) == 0
                for piece, start, stop in s:
                    assert start < stop
                    places[piece].append((start, stop))
            assert {p: [x for a, b in sorted(v) for x in range(a, b)] for p, v in places.items()} == {p: list(range(k)) for p, k in enumerate(lengths)}
            # Only sequences handed out or the short ones at the end cut anything: whole documents stay the rule.
            if n == 200:
                assert sum(len(v) == 1 for v in places.values()) >= 150


@pytest.mark.parametrize("group_docs", [2, 4096])
def test_pack_padded(spark, docs, none, odd, corpus, group_docs):
    texts = dict(corpus) | {10_000 + i: t for i, t in enumerate(ODD)}
    more = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).withColumn("ids", F.lit(1)).withColumn("start", F.lit("x"))
    pieces = pack_padded(more, BYTES, group_docs=group_docs, with_ids=True).cache()
    whole = {i: ids_of(t or "", False) + [1] for i, t in texts.items()}
    parts, places = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        assert r["doc_tokens"] == len(whole[r["id"]]) and r["length"] == len(r["ids"])
        assert r["crc"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        parts[r["id"]].append((r["start"], r["ids"]))
        places[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in parts.items()} == whole
    for p in places.values():
        end = 0
        for offset, length, _ in sorted(p):
            assert offset == end
            end += length
        assert end == 2048 or end & (end - 1) == 0
    made = {r["sequence_id"]: r["ids"] for r in token_sequences(pieces).collect()}
    assert made == {s: [x for _, _, ids in sorted(p) for x in ids] for s, p in places.items()}
    assert pack_padded(none, BYTES).count() == 0
    assert sorted(r["doc_tokens"] for r in pack_padded(odd, BYTES).select("id", "doc_tokens").distinct().collect())[:2] == [1, 1]
