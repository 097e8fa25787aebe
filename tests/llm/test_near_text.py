"""Near duplicates of five-word shingles against brute force."""

import random

import numpy as np
import pytest

from tidewater.llm import near_text


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        out.append(" ".join(base))
        for changes in (0, 1, 2, 3, 6, 12, 40):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


SCHEMA = "doc_id long, text string, node string, sig int"


def kept(spark, texts):
    rows = [(k, t, "n", 1) for k, t in enumerate(texts)]
    got = near_text.one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "text", "node", "sig"]
    return sorted(r["doc_id"] for r in got.collect())


def test_similar_texts_go_and_others_stay(spark, texts):
    stay = kept(spark, texts)
    gone = set(range(len(texts))) - set(stay)
    # Exactly the smallest of each component of pairs of similarity 0.8 or more.
    root = list(range(len(texts)))
    links = [(a, b) for a in range(len(texts)) for b in range(a) if similarity(texts[a], texts[b]) >= 0.8]
    assert any(similarity(texts[a], texts[b]) < 0.82 for a, b in links)
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert stay == sorted(set(root)) and len(gone) > 100
    assert stay == kept(spark, texts)


def test_a_text_that_is_unlike_does_not_hide_others(spark, monkeypatch):
    """Families of texts that are alike by all bits that are compared first and not by their shingles."""
    monkeypatch.setattr(near_text, "CHECK", 32)
    monkeypatch.setattr(near_text, "LIMIT", 1408)
    rng = random.Random(9)
    texts = []
    for family in range(15):
        base = [f"f{family}w{k}" for k in range(200)]
        for member in range(6):
            start = rng.randrange(60)
            own = [*base[:start], *(f"m{family}-{member}-{j}" for j in range(60)), *base[start + 60 :]]
            texts += [" ".join(own), " ".join([*own[:-3], "tail"])]
    stay = kept(spark, texts)
    assert stay == list(range(0, len(texts), 2))


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(50)) for x in "ab")
    rows = [(1, a, "n", 1), (1, b, "n", 1), (2, b + " end", "n", 1), (1, a, "n", 1)]
    for _ in range(2):
        got = near_text.one_of_each(spark.createDataFrame([(*r, "k") for r in rows], SCHEMA + ", key string"))
        assert sorted((r["doc_id"], r["text"], r["key"]) for r in got.collect()) == [(1, a, "k"), (1, b, "k")]


def test_links_join_all_of_a_large_group_of_slight_variations(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join([*base[:k], f"y{j}", *base[k + 1 :]]) for j in range(1500) for k in [rng.randrange(300)]]
    assert kept(spark, texts) == [0]


def test_batches_of_a_bucket_meet_as_one(spark, texts, monkeypatch):
    whole = kept(spark, texts)
    monkeypatch.setattr(near_text, "EXPAND", 3)
    assert whole == kept(spark, texts)


def test_edge_cases(spark):
    long = " ".join(f"v{k % 911}x{k}" for k in range(40000))
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, " \t ", "a", 1), (4, "one two", "a", 1), (5, "ONE  two", "a", 1), (6, "one", "a", 1), (7, long, "a", 1), (8, long + " end", "a", 1)]
    rows += [(9, "same id", "a", 1), (9, "same id", "a", 1), (None, "one", "a", 1), (None, "one", "a", 1)]
    got = near_text.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 1, 4, 6, 7, 9]
    assert not near_text.one_of_each(spark.createDataFrame([], SCHEMA)).collect()


def test_signature_is_a_majority_of_hashes():
    assert near_text.signature(None) == near_text.signature("  ") == bytes(near_text.PIECES * 4)
    text = " ".join(str(k) for k in range(700))
    hashes = np.array([near_text.xxhash.xxh64_intdigest(" ".join(map(str, range(k, k + 5))), near_text.SEED) for k in range(696)], np.uint64)
    bits = np.unpackbits(near_text._spread(hashes).view(np.uint8), axis=1).mean(axis=0) > 0.5
    assert near_text.signature(text) == np.packbits(bits).tobytes()


@pytest.mark.parametrize("rows", [1_000_000, 200])
def test_every_pair_that_meets_is_reported_or_in_a_crowd(spark, monkeypatch, rows):
    monkeypatch.setattr(near_text, "BUCKET_ROWS", rows)
    rng = np.random.default_rng(4)
    keys = {}
    for piece in (0, 5):
        bases = [int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in rng.integers(0, 1 << 32, 12) for x, y in rng.integers(0, 8, (25, 2))]
        keys[piece] = sorted({(b << 32 | int(c)) - (b >> 31 << 64) for b in bases for c in rng.choice([3, 7, 0xFFFF0000], 1)})
    frame = spark.createDataFrame([(p, k) for p, some in keys.items() for k in some], "piece int, key long")
    got = near_text.near_keys(frame).collect()
    direct = [(r["piece"], *sorted((r["a"], r["b"]))) for r in got if not r["crowd"]]
    assert len(direct) == len(set(direct)) and any(r["crowd"] for r in got)
    root = {(p, k): (p, k) for p, some in keys.items() for k in some}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        if r["crowd"]:
            root[top((r["piece"], r["a"]))] = top((r["piece"], r["b"]))
    ones = lambda x: (x & 0xFFFFFFFF).bit_count()
    near = {(p, a, b) for p, some in keys.items() for a in some for b in some if a < b and ones(a >> 32 ^ b >> 32) <= 2 and ones(a ^ b) <= near_text.CHECK}
    assert len(near) > 500 and set(direct) <= near
    assert all((p, a, b) in set(direct) or top((p, a)) == top((p, b)) for p, a, b in near)


def test_a_family_hands_out_no_pairs_with_its_square(spark, monkeypatch):
    """Texts that are alike by bits and not by their shingles, each with one near copy, are verified in the task of their block."""
    rng, n, handed = random.Random(3), 300, []
    base = [f"w{k}" for k in range(400)]
    texts = []
    for member in range(n):
        own = list(base)
        for k in rng.sample(range(80), 14):
            own[5 * k] = f"m{member}-{k}"
        texts += [" ".join(own), " ".join([*own, "tail"])]
    assert max(similarity(texts[0], t) for t in texts[2:]) < 0.8
    for name in ("near_by_bits", "similar_pairs"):

        def counted(pairs, more, plain=getattr(near_text, name)):
            handed.append(pairs.count())
            return plain(pairs, more)

        monkeypatch.setattr(near_text, name, counted)
    monkeypatch.setattr(near_text, "BLOCK", 100)
    monkeypatch.setattr(near_text, "LIMIT", 1408)
    assert kept(spark, texts) == list(range(0, 2 * n, 2))
    assert sum(handed) < n * (2 * n - 1) / 4
