"""The pipeline's stages, each on what the one before kept, against brute force on the smallest tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from plumbline.llm import mixing, simhash
from plumbline.llm._common import read

SF = "/root/testdata/sf0.001"


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def distinct_word_print(text):
    from xxhash import xxh64_intdigest

    hashes = {xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", lower(text))}
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_mixing_stage_keeps_clean_documents(spark):
    """On a table with a few hundred labels; on the smallest one, with 11 toxic rows, 64 of 67 clean documents stay."""
    sf = "/root/testdata/sf0.01"
    out = dict(cp.STAGES)["mixing sources to target weights"](spark, read(spark, sf, "documents"), sf)
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    labels = read(spark, sf, "labels").collect()
    clean, toxic = [r["doc_id"] for r in labels if r["quality"] and not r["toxic"]], [r["doc_id"] for r in labels if r["quality"] and r["toxic"]]
    assert sum(i in kept for i in clean) > 0.97 * len(clean) and sum(i in kept for i in toxic) < 0.2 * len(toxic)


FILLER = " ".join(f"word{i}" for i in range(60))
ODD = "doc_id long, text string, lang string, source string, n_chars long, row_key string, kept string, component string, copies string"


def odd_rows():
    """Null ids and texts, repeated rows, one id with two texts, a line that many share, clashing columns."""
    own = lambda i: " ".join(f"t{i}x{k}" for k in range(80))
    rows = [(1, own(1)), (1, own(1)), (1, own(1)), (1, own(2)), (None, own(1)), (None, own(3)), (None, own(3)), (None, "few words"), (None, None), (2, None), (3, ""), (4, own(4) + " tail"), (5, own(4)), (None, own(4) + " end")]
    rows += [(100 + i, f"the shared line of all\n{' '.join(f'{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}' for k in range(60))}") for i in range(40)]
    return [(i, t, None, "s", 7, "x", "x", "x", "x") for i, t in rows]


def test_stages_on_odd_rows(spark):
    stages, docs = dict(cp.STAGES), spark.createDataFrame(odd_rows(), ODD)
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    every = rows(docs)
    judged = rows(stages["quality rules"](spark, docs, SF))
    want = Counter({(i, "\n".join(x for x in t.split("\n") if x != "the shared line of all")): n for (i, t), n in every.items() if t and len(t.split()) >= 50})
    assert judged == want
    exact = rows(stages["exact dedup"](spark, docs, SF))
    texts = defaultdict(list)
    for (i, t), n in every.items():
        texts[lower(t or "")] += [i] * n
    assert Counter(lower(t or "") for _, t in exact.elements()) == Counter(dict.fromkeys(texts, 1))
    assert all(i == max((j for j in texts[lower(t or "")] if j is not None), default=None) for i, t in exact)
    near = rows(stages["SimHash near-dedup"](spark, docs, SF))
    firsts = {t.split()[0] if t else "": i for i, t in near}
    assert firsts["t1x0"] == 1 and firsts["t3x0"] is None and firsts["t4x0"] == 4 and sum(near.values()) == 7 + 40 - 1
    mixed = stages["mixing sources to target weights"](spark, docs, SF)
    assert set(rows(mixed)) <= set(every) and tuple(mixed.columns) == cp.COLUMNS
    assert stages["best-fit packing"](spark, docs, SF).count() >= docs.count()
    for name, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0, name


def test_similar_groups(spark):
    """Against brute force, with classes of one fingerprint, and buckets that are too large and dealt on."""
    import random

    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 3) for _ in range(120)).split() for _ in range(4)]
    docs = []
    for i in range(160):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 6])):
            words[rnd.randrange(len(words))] = rnd.choice(["new", "other", "a", "bb"])
        if rnd.random() < 0.3:  # the same words in another order: the same fingerprint, other shingles
            cut = rnd.randrange(len(words))
            words = words[cut:] + words[:cut] if rnd.random() < 0.5 else rnd.sample(words, len(words))
        docs.append((f"k{i:03}", " ".join(words)))
    prints, sets = [distinct_word_print(t) for _, t in docs], [five_words(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 6 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {docs[i][0]: docs[root(i)][0] for i in range(len(docs))}
    groups = lambda **k: {r["id"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(docs, "id string, text string"), key="id", **k).collect()}
    assert groups() == want and groups(small=4, block=16, leaf=8, pivots=4) == want
    assert 10 < len(set(want.values())) < 150


def test_similar_groups_of_one_fingerprint(spark):
    """200 orders of the same words, each a few swaps away from one: many pairs stand near the limit."""
    import random

    for swaps in ((3, 6), (4, 7)):
        rnd = random.Random(11)
        base = [f"word{i}" for i in range(240)]
        docs = []
        for i in range(200):
            words = list(base)
            for _ in range(rnd.randint(*swaps)):
                at = rnd.randrange(len(words) - 1)
                words[at], words[at + 1] = words[at + 1], words[at]
            docs.append((i, " ".join(words)))
        sets, root = [five_words(t) for _, t in docs], list(range(len(docs)))
        for i in range(len(docs)):
            for j in range(i):
                if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        for sizes in ({}, {"leaf": 20, "pivots": 4, "block": 30}):
            assert {r["doc_id"]: r["component"] for r in simhash.similar_groups(df, **sizes).collect()} == dict(enumerate(root))


def test_stages_against_brute_force(spark):
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality rules", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    docs = read(spark, SF, "documents").select(*cp.COLUMNS)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def after(name, df):
        out = cp.store(stages[name](spark, df, SF), "test-pipeline")
        assert tuple(out.columns) == cp.COLUMNS
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    out, kept = after("quality rules", docs)
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = defaultdict(list)
        for at, w in enumerate(zip(words, words[1:], words[2:])):
            windows[w].append(at)
        again = {a + k for places in windows.values() if len(places) > 1 for a in places for k in range(3)}
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        lines = iter(t.split("\n"))
        assert i not in kept if failed else i in kept and all(line in lines for line in kept[i].split("\n"))

    groups = defaultdict(list)
    for i, t in kept.items():
        groups[lower(t)].append(i)
    out, kept = after("exact dedup", out)
    assert set(kept) == {max(ids) for ids in groups.values()}

    ids = sorted(kept)
    prints, sets, least = [distinct_word_print(kept[i]) for i in ids], [five_words(kept[i]) for i in ids], {}
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= cp.NEAR_RADIUS and 100 * len(sets[i] & sets[j]) >= cp.SIMILARITY * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    for i, doc in enumerate(ids):
        least.setdefault(root(i), doc)
    out, kept = after("SimHash near-dedup", out)
    assert set(kept) == set(least.values())

    before, rates = kept, {r["doc_id"]: r["rate"] for r in mixing.mix(out, read(spark, SF, "labels"), cp.TARGETS).collect()}
    out, kept = after("mixing sources to target weights", out)
    copies = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert all(kept[i] == before[i] for i in kept) and all(rates[i] - 1 < copies[i] <= rates[i] + 1 for i in before)

    rows = stages["best-fit packing"](spark, out, SF).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(kept) and all(len(p) % copies[i] == 0 for i, p in pieces.items())
    for runs in ([x for x in set(p) for _ in range(1)] for p in pieces.values()):
        assert sum(n for _, n in runs) == max(start + n for start, n in runs)
    for runs in places.values():
        end = 0
        for start, length in sorted(runs):
            assert start == end and 0 < length <= 1024
            end = start + length
    assert all(sum(n for _, n in runs) <= 1024 for runs in places.values())
