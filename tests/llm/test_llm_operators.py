"""The operators of the llm subpackage against brute force, on texts with every kind of odd row."""

import collections
import hashlib
import math
import os
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import differences  # noqa: E402

from tidewater.llm import chat, decontaminate, language, lm, mixing, quality, registry, sharding, simhash, suffix_dedup, toxicity  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, key string, h string, rid string"
TOXIC = "you stupid moron and scum"


def odd_rows():
    rng = np.random.default_rng(3)
    words = {"en": ["the", "of", "house", "river", "and", "with", "stone", "walk"], "de": ["der", "und", "straße", "über", "mit", "stein", "gehen", "fluß"], "fr": ["le", "et", "maison", "rivière", "été", "avec", "pierre", "marcher"]}
    out = []
    for k in range(140):
        lang = ("en", "de", "fr")[k % 3]
        body = [str(rng.choice(words[lang])) + (f"{rng.integers(1000)}" if rng.random() < 0.3 else "") for _ in range(int(rng.integers(3, 160)))]
        if k % 5 == 0:
            body[len(body) // 2 : len(body) // 2] = TOXIC.split() + ["."]
        out.append((k, " ".join(body), lang, f"src{k % 4}"))
    shared = " ".join(f"shared{k} passage" for k in range(30))
    out += [(200 + k, f"{'intro ' * k}{shared} {'outro%d ' % k * 3}", "en", "src0") for k in range(6)]
    out += [(300, None, None, None), (301, "", "en", ""), (302, "12 34 !!", None, "src1"), (303, "é", "fr", None), (304, "a\nb\n\na\n \n", "en", "src2")]
    out += [(305, "spam eggs " * 4000, "en", "src0"), (306, "x" * 1500, "en", "src1"), (307, out[9][1], "en", "src3"), (308, out[9][1], "en", "src3"), (308, out[9][1], "en", "src3")]
    out += [(309, out[12][1] + " tail", "en", "src3"), (None, "no id at all here", "en", "src1"), (None, None, None, None)]
    return [(i, t, lang, s, len(t or ""), 7, "x", "y", None, "z") for i, t, lang, s in out]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_equals_sql(spark, name):
    assert not differences(spark, registry.QUERIES[name], registry.SQL[name], FOLDER)


def multiset(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_repeats_are_removed_exactly(docs, none, rows, monkeypatch):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    starts = collections.Counter(d[k : k + 200] for _, d in data for k in range(len(d) - 199))
    want = collections.Counter()
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - 199):
            if starts[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i, len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()] += 1
    assert multiset(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    # Every rank hot, and buckets of a few bytes.
    monkeypatch.setattr(suffix_dedup, "HOT", 10**9)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    assert multiset(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_texts_longer_than_a_piece(monkeypatch):
    rng = np.random.default_rng(5)
    data = bytes(rng.integers(97, 123, 5000, dtype=np.uint8))
    whole = [x.tolist() for x in suffix_dedup.anchor_rows(data)]
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
    assert [x.tolist() for x in suffix_dedup.anchor_rows(data)] == whole


def test_language(docs, none, rows, monkeypatch):
    model = language.fit(language.training_rows(docs))
    assert set(model.languages) == {"en", "de", "fr"}
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert np.mean([found[k]["lang_pred"] == ("en", "de", "fr")[k % 3] for k in range(140)]) > 0.95
    assert all(found[k]["lang_pred"] == "und" and found[k]["rejected"] for k in (300, 301, 302))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    kept = {r["doc_id"] for r in language.known_language(docs, model).collect()}
    assert set(range(140)) <= kept and not kept & {300, 301, 302}
    # More languages than one pass compares are compared in several.
    whole = [multiset(language.identify(docs, model), "doc_id", "lang_pred", "rejected"), multiset(language.known_language(docs, model), "doc_id")]
    monkeypatch.setattr(language, "BLOCK_LANGUAGES", 1)
    assert len(model.blocks()) == 3
    assert whole == [multiset(language.identify(docs, model), "doc_id", "lang_pred", "rejected"), multiset(language.known_language(docs, model), "doc_id")]
    empty = language.fit(none)
    assert {r["lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_a_language_that_was_not_learned_is_rejected(spark):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()
    for out in ("de", "en", "es", "fr"):
        model = language.fit(language.training_rows(whole.filter(f"lang <> '{out}'")))
        found = whole.select("doc_id", "lang").join(language.identify(whole.filter("text rlike '[a-z]{2}'"), model), "doc_id").filter("lang is not null").collect()
        foreign = np.mean([r["rejected"] for r in found if r["lang"] == out])
        own = np.mean([r["rejected"] for r in found if r["lang"] != out])
        assert foreign > 0.9 and own < 0.02, (out, foreign, own)
    whole.unpersist()


def test_chat(spark):
    said = [(1, 0, "user", "Hello there my friend.\nHow is the weather today?"), (1, 1, "assistant", "> How is the weather today?\nIt is sunny and warm here."), (1, 2, "user", ">> How is the weather today?\n> It is sunny, and warm here\nThanks a lot for that."), (2, 0, "user", "> Thanks a lot for that.\nquoting elsewhere"), (2, 1, None, None), (2, 2, "user", "> never said by anyone\nwell then"), (None, 0, "user", "x"), (2, None, "user", "zero"), (3, 1, "a", "same"), (3, 1, "a", "same")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in said], "conv_id long, turn long, role string, text string, position int, h int")
    got = {(r["conv_id"], r["position"]): r for r in chat.link_messages(frame).collect()}
    assert len(got) == len(said)
    assert got[1, 2]["parent_position"] == 1 and got[1, 2]["n_linked"] == 2 and got[1, 2]["max_level"] == 2 and got[1, 2]["text"] == "Thanks a lot for that."
    assert (got[2, 1]["parent_conv"], got[2, 1]["parent_position"]) == (1, 2)
    assert got[2, 0]["turn"] is None and got[2, 2]["text"] == ""
    assert (got[2, 3]["n_linked"], got[2, 3]["parent_position"]) == (0, 2)
    assert chat.link_messages(frame.limit(0)).count() == 0


def test_chat_links_to_another_conversation_and_short_quotes_to_their_own(spark):
    said = [
        (1, 0, "user", "> A passage said by many\nquoted first"), (1, 1, "user", "A passage said by many"), (2, 0, "user", "A passage said by many"), (3, 0, "user", "first of three"), (3, 1, "user", "A passage said by many"),
        (4, 0, "user", "> A passage said by many\nquoted"), (5, 0, "user", "Yes"), (5, 1, "assistant", "And then?"), (5, 2, "user", "> Yes\nwhy"), (6, 0, "user", "> Yes\nsaid only elsewhere"),
    ]
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["position"]): (r["parent_conv"], r["parent_position"], r["n_linked"]) for r in chat.link_messages(frame).collect()}
    assert got[1, 0] == (2, 0, 1) and got[4, 0] == (1, 1, 1)
    assert got[5, 2] == (5, 0, 1) and got[6, 0] == (None, None, 0)


def brute_threads(said):
    """Parents, threads and depths by walking from message to message. said: (conv, position, text), in order."""
    parsed = {(c, p): chat.parse(t) for c, p, t in said}
    origin = collections.defaultdict(list)
    for at, (_, _, own) in parsed.items():
        for h in own:
            origin[h].append(at)
    link, n_linked = {}, collections.Counter()
    for (c, p), (_, quotes, _) in parsed.items():
        for _, hashes in sorted(quotes, key=lambda q: q[0]):
            for h in hashes:
                here = [x for x in origin[h] if x[0] == c and x[1] < p]
                away = [x for x in origin[h] if x[0] != c and not h & 1]
                if here or away:
                    n_linked[c, p] += 1
                    link.setdefault((c, p), max(here) if here else min(away))
                    break
    step = lambda at: link.get(at, (at[0], at[1] - 1) if at[1] else None)
    for at in list(link):
        seen, x = [], at
        while x is not None and x not in seen:
            seen.append(x)
            x = step(x)
        if x is not None:
            link[min(y for y in seen[seen.index(x) :] if y in link)] = None
    out = {}
    for at in parsed:
        x, depth = at, 0
        while (up := step(x)) is not None:
            x, depth = up, depth + 1
        out[at] = (*(step(at) or (None, None)), *x, depth, n_linked[at])
    return out, list(link.values()).count(None)


@pytest.mark.parametrize("seed", [1, 2])
def test_threads_equal_brute_force(spark, monkeypatch, seed):
    """Passages that many say, quotes of quotes, circles, long and short ones; cells of three positions."""
    monkeypatch.setattr(chat, "CELL", 3)
    rng = np.random.default_rng(seed)
    phrases = [f"this is passage number {k} of them" for k in range(9)] + ["ok", "yes"]
    said = []
    for conv in range(12):
        for position in range(int(rng.integers(1, 14))):
            lines = [str(rng.choice(phrases))] if rng.random() < 0.7 else [f"own words {conv} {position}"]
            for _ in range(int(rng.integers(0, 3))):
                lines.insert(0, ">" * int(rng.integers(1, 3)) + " " + str(rng.choice(phrases)))
            said.append((conv, position, "\n".join(lines)))
    want, circles = brute_threads(said)
    frame = spark.createDataFrame([(c, p * 10, "user", t) for c, p, t in said], "conv_id long, turn long, role string, text string").repartition(4)
    got = chat.link_messages(frame).collect()
    assert {(r["conv_id"], r["position"]): (r["parent_conv"], r["parent_position"], r["thread_conv"], r["thread_position"], r["depth"], r["n_linked"]) for r in got} == want
    places = {(r["conv_id"], r["position"]): (r["thread_conv"], r["thread_position"], r["place"]) for r in got}
    sizes = collections.Counter(p[:2] for p in places.values())
    assert sorted(places.values()) == sorted((*thread, k) for thread, n in sizes.items() for k in range(n))
    assert all(places[r["parent_conv"], r["parent_position"]][2] < r["place"] for r in got if r["parent_position"] is not None)
    assert circles


def test_a_long_conversation_has_places(spark):
    n = chat.CELL + 500
    frame = spark.range(n).selectExpr("7L as conv_id", "if(id < 300, null, id div 2) as turn", "'user' as role", "concat('message ', id) as text")
    got = chat.link_messages(frame).collect()
    assert sorted(r["position"] for r in got) == sorted(r["place"] for r in got) == list(range(n))
    order = [r["turn"] for r in sorted(got, key=lambda r: r["position"])]
    assert order == sorted(order, key=lambda t: -1 if t is None else t)
    assert all(r["depth"] == r["position"] and (r["thread_conv"], r["thread_position"]) == (7, 0) for r in got)


def test_mixing(docs, none, rows):
    mixed, slots = mixing.mix(docs)
    got = mixed.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r[0], size(r[1])) for r in rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    order = sorted((s for s in by if s is not None)) + [None]
    want = brute_targets([by[s][0] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    for s, t in zip(order, want, strict=True):
        assert abs(by[s][2] - t) < 1e-6 and by[s][1] == round(t)
    assert math.isclose(sum(want), 1.5 * sum(b[0] for b in by.values()))
    assert multiset(mixing.mix(docs)[0], "doc_id", "taken") == multiset(mixed, "doc_id", "taken")
    assert slots.count() > 0 and mixing.mix(none)[0].count() == 0


def test_permutation_and_slots():
    for n in (1, 2, 3, 17, 1000):
        p = mixing.permuted(np.arange(n), n, 4)
        assert sorted(p.tolist()) == list(range(n))
        assert mixing.permuted(p, n, 4, inverse=True).tolist() == list(range(n))
    for size in (1, 2047, 2048, 2049, 9001):
        blocks = -(-size // mixing.BLOCK)
        for want in {0, 1, size // 2, size, size + 5, 2 * size}:
            n, cut = mixing.slot_count(size, want, 2)
            lengths = [min(mixing.BLOCK, size - b * mixing.BLOCK) for b in (mixing.permuted(np.arange(n) % blocks, blocks, 2).tolist() if n else [])]
            assert sum(lengths[:-1]) + (cut or sum(lengths[-1:])) == want
    drawn = mixing.draws(np.array([9000, 1, 0, 300]))
    assert drawn.sum(axis=0).tolist() == [9000, 1, 0, 300] and len(drawn) == 3


def brute_targets(sizes, weights):
    """Water filling by bisection of the level."""
    low, high = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2.0 * n, w * mid) for n, w in zip(sizes, weights, strict=True)) < 1.5 * sum(sizes) else (low, mid)
    return [min(2.0 * n, w * low) for n, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("groups", [1024, 2])
def test_blocks_of_the_mix(spark, docs, rows, groups, monkeypatch):
    """All blocks together are the words that mix() says are taken, whatever the number of groups of sources."""
    monkeypatch.setattr(mixing, "GROUPS", groups)
    monkeypatch.setattr(mixing, "BLOCK", 64)
    monkeypatch.setattr(mixing, "SLOT_ROWS", 10)
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 50)
    blocks = mixing.mixed_blocks(docs).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    taken, wanted = collections.Counter(), collections.Counter()
    texts = collections.defaultdict(set)
    for r in rows:
        texts[r[0], r[3]].add(r[1])
    for r in mixing.mix(docs)[0].collect():
        wanted[r["source"]] += r["taken"]
    for b in blocks:
        assert 0 < len(split(b["text"])) <= 64
        taken[b["source"]] += len(split(b["text"]))
    assert +taken == +wanted and len({b["out_shard"] for b in blocks}) > 1
    places = collections.defaultdict(list)
    for b in blocks:
        places[b["source"]].append(b["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    per_shard = collections.Counter(b["out_shard"] for b in blocks)
    assert all(per_shard[k] == 50 for k in range(max(per_shard)))


def test_mixed_documents_keep_the_targets(spark, docs, rows):
    frame = docs.selectExpr("*", "1 as copies", "2 as h1", "3 as _h1")
    got = mixing.mixed_documents(frame)
    assert got.columns == frame.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source, most = collections.Counter(), collections.Counter()
    for r in rows:
        source[r[3]] += size(r[1])
        most[r[3]] = max(most[r[3]], size(r[1]))
    order = sorted((s for s in source if s is not None)) + [None]
    want = dict(zip(order, mixing.targets([source[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    out = collections.Counter()
    for r in got.collect():
        out[r["source"]] += size(r["text"])
    assert all(abs(out[s] - want[s]) <= most[s] for s in order)
    assert None in {r["doc_id"] for r in got.collect()}
    twice = spark.createDataFrame([(1, "a b c", "x")] * 5 + [(None, "d e", "x"), (1, "other words here now", "x"), (2, " ", "x")], "doc_id long, text string, source string")
    times = collections.Counter(r["text"] for r in mixing.mixed_documents(twice).collect())
    assert abs(times["a b c"] * 3 + times["d e"] * 2 + times["other words here now"] * 4 - 31.5) <= 4 and set(times) <= {"a b c", "d e", "other words here now"}


def best_capacity(sizes, n):
    def parts(c):
        used, room = 1, c
        for s in sizes:
            used, room = (used, room - s) if s <= room else (used + 1, c - s)
        return used

    return next(c for c in range(max(max(sizes), -(-sum(sizes) // n)), sum(sizes) + 1) if parts(c) <= n)


@pytest.mark.parametrize("n", [1, 3, 16])
def test_sharding_is_minimax(docs, none, rows, n):
    got = sharding.shard_documents(docs, n).collect()
    assert len(got) == len(rows)
    groups, shards, slots = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    for r in got:
        groups[r["key"]] += r["size"]
        shards[r["key"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in shards.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = collections.Counter()
    for k, v in groups.items():
        total[min(shards[k])] += v
    assert max(total.values()) == best_capacity([groups[k] for k in sorted(groups)], n)
    places = [min(shards[k]) for k in sorted(groups)]
    assert places == sorted(places)
    assert sharding.shard_documents(none, n).count() == 0


def test_quality_ledger(docs, none, rows):
    found = quality.ledger(docs)
    got = multiset(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = collections.Counter()
    for r in rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        times = collections.Counter(windows)
        covered = {p for k, w in enumerate(windows) if times[w] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)] += 1
    assert got == want
    kept = {v: quality.apply_policy(found, v).filter("kept").count() for v in quality.POLICIES}
    assert kept[2] <= kept[1]
    for r in quality.ablations(found).collect():
        others = quality.policy_mask() & ~quality.BIT[r["rule"]]
        bits = [x["fail_bits"] & quality.policy_mask() for x in found.select("fail_bits").collect()]
        assert r["kept_without"] == sum(not b & others for b in bits) and r["failed"] == sum(bool(b & quality.BIT[r["rule"]]) for b in bits)
    assert quality.ledger(none).count() == 0


def test_decontamination(spark, docs, none, monkeypatch):
    words = [f"b{k}" for k in range(30)]
    items = [(1, " ".join(words)), (10, " ".join(words[5:20])), (2, "Tiny item"), (3, None), (4, "..."), (5, "tiny ITEM!")]
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    texts = [(1, "x " + " ".join(words[4:15]) + " y tiny, item z", 1), (2, " ".join(words[:9]), 2), (3, None, 3), (4, "", 4), (5, "clean words only " * 3, 5), (6, " ".join(words), 6)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, n_chars long")

    def brute(text):
        split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        doc, hit, found = split(text), set(), set()
        for i, t in items:
            w = split(t)
            n = min(10, len(w))
            for a in range(len(w) - n + 1) if n else ():
                for b in range(len(doc) - n + 1):
                    if doc[b : b + n] == w[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(i))
        return len(doc), len(hit), tuple(sorted(found))

    for block in (100_000, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.contamination(frame, bench).collect()}
        assert got == {i: brute(t) for i, t, _ in texts}
        # Columns that are named like those the operator makes stay.
        named = frame.selectExpr("*", "1 as h1", "2 as _mask", "3 as items", "4 as _hit_words")
        kept = decontaminate.spans_removed(named, bench, 0.9)
        assert kept.columns == named.columns
        left = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert 6 not in left and left[5] == texts[4][1] and left[3] is None
        assert all(brute(t)[1] == 0 for t in left.values())
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.spans_removed(none, bench).count() == 0


def brute_fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    pieces = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(docs, none, rows):
    got = simhash.near_duplicates(docs.filter("doc_id is not null")).collect()
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows if r[0] is not None}
    assert all(r["fp"] % (1 << 64) == fps[r["doc_id"]] for r in got)
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {r["doc_id"]: r["component_id"] for r in got} == root
    assert simhash.near_duplicates(none).count() == 0


def test_ball_hashing_finds_every_distance(spark):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    fps = set(base)
    for k, x in enumerate(base):
        for n in (1, 2, 3, 4):
            bits = rng.choice(64, n, replace=False)
            fps.add(x ^ sum(1 << int(b) for b in bits) if k % 2 else x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.fingerprint_links(frame).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    assert all(find(a) == find(b) for a in fps for b in fps if (a ^ b).bit_count() <= 3)


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(k, int(k % 5 == 0), 1) for k in range(140)] + [(0, 1, 1), (7, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all((got[k]["score"] >= toxicity.THRESHOLD) == (k % 5 == 0) for k in range(140))
    assert got[300]["score"] == 0 and got[301]["worst_sentence"] is None
    bad = toxicity.offending_sentences(docs, model).filter("doc_id < 140").collect()
    assert bad and all("moron" in r["words"] for r in bad)
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


def test_language_model(docs, none, rows):
    from pyspark.sql import functions as F

    from tidewater.llm.patterns import id_remainder

    held_out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % lm.FOLDS == lm.HELD_OUT
    got = lm.score(docs, id_remainder("doc_id", lm.FOLDS) != lm.HELD_OUT).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = collections.Counter(w for r in rows if not held_out(r[0]) for w in tokens(r[1]))
    n, base = sum(counts.values()), {}
    for r in rows:
        w = tokens(r[1])
        base[r[0], len((r[1] or "").encode())] = (len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + len(counts) + 1)) for x in w))
    assert len(got) == len(rows)
    for r in got:
        want = base[r["doc_id"], r["n_bytes"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (*want[:2], n) and math.isclose(r["base_score"], want[2], rel_tol=1e-9)
        assert r["score"] < 0 and r["train"] != held_out(r["doc_id"])
    assert lm.score(none, F.lit(True)).count() == 0
    assert lm.score(docs, F.lit(False)).filter("train_tokens = 0").count() == len(rows)


def weighted_tree(texts):
    """Context-tree weighting as it is defined, with dictionaries: a function that scores bytes."""
    counts = [collections.defaultdict(lambda: [0, 0]) for _ in range(lm.DEPTH + 1)]

    def decisions(data):
        padded = b"\0" * lm.DEPTH + data + b"\xff"
        for k in range(lm.DEPTH, len(padded)):
            for level in range(8):
                node, bit = 1 << level | padded[k] >> 8 - level, padded[k] >> 7 - level & 1
                yield [(padded[k - d : k], node) for d in range(lm.DEPTH + 1)], bit

    for text in texts:
        for contexts, bit in decisions(text):
            for d, at in enumerate(contexts):
                counts[d][at][bit] += 1
    weight, kt, below = [], [], {}
    for d in range(lm.DEPTH, -1, -1):
        up, w = collections.defaultdict(float), {}
        for (context, node), (zeros, ones) in counts[d].items():
            log_pe = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)
            log_pw = log_pe
            if d < lm.DEPTH:
                log_pw = math.log(0.5) + np.logaddexp(log_pe, below[context, node])
                w[context, node] = math.exp(math.log(0.5) + log_pe - log_pw)
            if d:
                up[context[1:], node] += log_pw
        below = up
        weight.insert(0, w)
        kt.insert(0, {at: (ones + 0.5) / (zeros + ones + 1) for at, (zeros, ones) in counts[d].items()})

    def score(text):
        total = 0.0
        for contexts, bit in decisions(text):
            p, left = 0.0, 1.0
            for d, at in enumerate(contexts):
                w = weight[d].get(at, 0.5) if d < lm.DEPTH else 1.0
                p, left = p + left * w * kt[d].get(at, 0.5), left * (1 - w)
            total += math.log10(p if bit else 1 - p)
        return total

    return score


@pytest.mark.parametrize("slice_bytes", [4 << 20, 150])
def test_language_model_is_the_weighted_tree(spark, monkeypatch, slice_bytes):
    """In one slice and bucket or in several; no number of contexts is too many, and long texts are cut."""
    from pyspark.sql import functions as F

    for name, value in (("SLICE_BYTES", slice_bytes), ("ASK_BYTES", 4 * slice_bytes), ("BUCKET_CODES", 5 * slice_bytes), ("_PIECE", 170), ("HELD", 1000)):
        monkeypatch.setattr(lm, name, value)
    rng = np.random.default_rng(8)
    # Copies, so that long contexts foretell the next byte; one text longer than a slice, one empty, one in other letters.
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrst "), 100)) for _ in range(5)] + ["the cat sat. " * 40, "", "straße ÉÉ \u4e2d"]
    rows = [(k, texts[k % 8], k % 7 != 2) for k in range(60)]
    rows += [rows[5], rows[5]]
    want = weighted_tree([t.encode() for _, t, train in rows if train])
    frame = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    got = lm.score(frame, F.col("train")).collect()
    assert len(got) == 62
    for r in got:
        text = texts[r["doc_id"] % 8].encode()
        assert math.isclose(r["score"], want(text), rel_tol=1e-6), (r, want(text))
    # Texts that were not learned from.
    other = spark.createDataFrame([(1, "abc def", True), (2, "zzzz unseen", False)], "doc_id long, text string, train boolean")
    want = weighted_tree([b"abc def"])
    assert all(math.isclose(r["score"], want(b"abc def" if r["doc_id"] == 1 else b"zzzz unseen"), rel_tol=1e-6) for r in lm.score(other, F.col("train")).collect())


def test_codes_are_counted_and_asked_once():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 500, 4000).astype(np.uint64)
    asked, cuts = lm._asked(codes, 7)
    assert sorted(asked.tolist()) == np.unique(codes).tolist() and cuts[-1] == len(asked)
    assert all((lm._bucket_of(asked[a:b], 7) == k).all() for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert lm._firsts(np.array([3, 3, 4, 9, 9])).tolist() == [True, False, True, True, False]


def test_log_gamma_of_whole_numbers_is_looked_up(monkeypatch):
    n = np.concatenate([np.arange(5000), [70_000, 10**9]]).astype(float)
    asked, slow = [], lm._lgamma
    monkeypatch.setattr(lm, "_lgamma", lambda x: (asked.append(len(x)), slow(x))[1])
    for more in (0.5, 1.0):
        assert np.array_equal(lm._log_gamma(n, more), slow(n + more))
    assert asked == [906, 906]


@pytest.mark.parametrize("texts", [1, 300, 70_000])
def test_codes_of_a_slice_in_order(texts):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 4, texts)
    codes, starts = rng.integers(0, 1 << 48, sizes.sum()).astype(np.uint64) >> np.uint64(36), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    found, text = lm._places(codes, starts)
    assert (np.diff(found.astype(np.int64)) >= 0).all()
    assert sorted(zip(found.tolist(), text.tolist(), strict=True)) == sorted(zip(codes.tolist(), np.repeat(np.arange(texts), sizes).tolist(), strict=True))
