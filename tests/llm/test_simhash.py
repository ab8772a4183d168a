import random
from collections import Counter

import numpy as np
import xxhash

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401

from graphloom.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes_of(values, radius=4):
    """Smallest index reachable from each value over pairs within the radius."""
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def near_copy_classes(texts):
    """As classes_of, over fingerprints within 4 bits or a similarity of 0.8 of five-word shingles."""
    words = [t.lower().split() if t else [] for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    prints = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            alike = bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if alike or (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprint(odd_rows):
    for row in odd_rows:
        text = row[1]
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_every_slice_pattern_covers_the_ball():
    for bits in (1, 8, 13):
        ways = simhash.flips(bits, 2)
        assert sum(map(len, ways.values())) == 2081
        one = np.array([0x0123456789ABCDEF], np.uint64)
        for change, masks in ways.items():
            assert (simhash.slice_number(one ^ masks, bits) == simhash.slice_number(one, bits) ^ change).all()


def near_values():
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(40)]
    for distance in range(8):  # single links, chains and values just too far
        for _ in range(12):
            value = rng.choice(values)
            for bit in rng.sample(range(64), distance):
                value ^= 1 << bit
            values.append(value)
    return values


def test_links_find_every_near_pair(spark):
    values = sorted(set(near_values()))
    rows = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    distinct = spark.createDataFrame(rows, "fp long")
    found = simhash.components(
        simhash.links(distinct, len(rows)), simhash.StageTables(spark, "test"), "rounds"
    ).collect()
    roots = {r.node: r.root for r in found}
    grouped = {}
    for (fp,), name in zip(rows, classes_of(values)):
        grouped.setdefault(name, set()).add(roots.get(fp, fp))
    assert all(len(g) == 1 for g in grouped.values())
    assert len({next(iter(g)) for g in grouped.values()}) == len(grouped)


def test_crowded_slices_take_turns(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)
    fp = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)))
    whole = [simhash.slice_links(fp, n, 4, 4) for n in range(16)]
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 5000)
    parts = [simhash.slice_links(fp, n, 4, 4) for n in range(16)]

    def joined(edges):
        label = np.arange(len(fp))
        for a, b in edges:
            pairs = np.stack([np.searchsorted(fp, a), np.searchsorted(fp, b)], axis=1)
            simhash.join_labels(label, pairs)
        return label.tolist()

    assert joined(whole) == joined(parts) == [0] * len(fp)


def test_classes(odd_docs, odd_rows, no_docs):
    found = simhash.classes(odd_docs.select("doc_id", "text")).collect()
    values = [plain_fingerprint(r[1]) for r in odd_rows]
    ids, smallest = [r[0] for r in odd_rows], {}
    roots = classes_of(values)
    for root, i in zip(roots, ids):
        if i is not None:
            smallest[root] = min(i, smallest.get(root, i))
    expected = Counter(zip(ids, values, (smallest.get(r) for r in roots)))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == expected
    assert simhash.classes(no_docs.select("doc_id", "text")).collect() == []


def test_keep_first(odd_docs, odd_rows, no_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    roots = classes_of([plain_fingerprint(r[1]) for r in odd_rows])
    assert len(rows) == len(set(roots))
    smallest = {}
    for root, r in zip(roots, odd_rows):
        smallest[root] = min(smallest.get(root, 1 << 60), 1 << 60 if r[0] is None else r[0])
    assert sorted(1 << 60 if r.doc_id is None else r.doc_id for r in rows) == sorted(smallest.values())
    assert simhash.keep_first(no_docs).collect() == []


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    found = simhash.components(spark.createDataFrame(edges, "a long, b long"), simhash.StageTables(spark, "t"), "r")
    rows = {r.node: r.root for r in found.collect()}
    assert rows == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


def test_keep_first_by_similarity(spark, odd_docs, no_docs):
    rng = random.Random(11)
    texts = []
    for group in range(40):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(60, 240))]
        texts.append(" ".join(words))
        for at in range(rng.randrange(0, 4)):  # words changed one after another, and more of them from copy to copy
            for _ in range(rng.randrange(1, 1 + len(words) // 60)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(3000)}"
            texts.append(" ".join(words).upper() if at % 2 else " ".join(words))
    texts += ["one two", "one two", "one two three four five six", "", None]
    rng.shuffle(texts)
    plain = [t.lower().split() if t else [] for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in plain]
    prints = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    similar = apart = 0
    for j in range(len(texts)):
        for i in range(j):
            near = (prints[i] ^ prints[j]).bit_count() <= 4
            alike = bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            similar, apart = similar + alike, apart + (alike and not near)
            if near or alike:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert apart >= 5 and similar > apart
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in simhash.keep_first(docs, similarity=0.8).collect())
    assert kept == [i for i in range(len(texts)) if root[i] == i]
    assert set(simhash.keep_first(odd_docs, similarity=0.8).columns) == set(odd_docs.columns)
    assert simhash.keep_first(no_docs, similarity=0.8).collect() == []


def test_a_large_group_in_many_classes_is_compared_with_representatives(spark, monkeypatch):
    """Copies of one text with changes that part their fingerprints: no pair rows, all in one class."""
    rng = random.Random(12)
    base = [f"v{rng.randrange(10**6)}" for _ in range(60)]
    texts = []
    for _ in range(400):
        words = list(base)
        words[rng.randrange(5, 55)] = f"c{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sizes = {}
    put = simhash.StageTables.put

    def counted(self, df, name, **metrics):
        out = put(self, df, name, **metrics)
        sizes[name] = out[0].count()
        return out

    monkeypatch.setattr(simhash.StageTables, "put", counted)
    kept = [r.doc_id for r in simhash.keep_first(docs, similarity=0.8).collect()]
    roots = near_copy_classes(texts)
    assert kept == [i for i in range(400) if roots[i] == i]
    assert max(n for name, n in sizes.items() if name.startswith(("good", "placed"))) <= 20 * 400 * 2


def test_rows_that_share_a_passage_only_are_not_all_compared(spark, monkeypatch):
    """Bands of one long passage between other words: few rounds, and the similar pairs among them stay."""
    rng = random.Random(13)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for at in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        texts.append(" ".join(words[:15] + passage + words[15:]))
        if at % 30 == 0:
            texts.append(" ".join(words[:15] + passage + words[15:29] + [f"c{at}"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sizes = {}
    put = simhash.StageTables.put

    def counted(self, df, name, **metrics):
        out = put(self, df, name, **metrics)
        sizes[name] = out[0].count()
        return out

    monkeypatch.setattr(simhash.StageTables, "put", counted)
    kept = [r.doc_id for r in simhash.keep_first(docs, similarity=0.8).collect()]
    roots = near_copy_classes(texts)
    assert kept == [i for i in range(len(texts)) if roots[i] == i] and len(kept) < len(texts) - 9
    assert sizes["flat"] > 300 and len([name for name in sizes if name.startswith("chosen")]) <= 5


def test_similar_rows_of_crowded_bands_meet_without_rows_for_every_band_and_length(spark, monkeypatch):
    """Rows of one passage and many lengths: every similar pair is found, and tables stay near the rows' shingles."""
    rng = random.Random(14)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for at in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(14 + at % 40)]
        texts.append(" ".join(words[:7] + passage + words[7:]))
        for _ in range(at % 5):  # each like the one before, the last seldom like the first
            words = words[:-2] + [f"c{rng.randrange(10**6)}"]
            words[0] = f"d{rng.randrange(10**6)}"
            texts.append(" ".join(words[:7] + passage + words[7:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sizes = {}
    put = simhash.StageTables.put

    def counted(self, df, name, **metrics):
        out = put(self, df, name, **metrics)
        sizes[name] = out[0].count()
        return out

    monkeypatch.setattr(simhash.StageTables, "put", counted)
    kept = sorted(r.doc_id for r in simhash.keep_first(docs, similarity=0.8).collect())
    roots = near_copy_classes(texts)
    assert kept == [i for i in range(len(texts)) if roots[i] == i]
    words = sum(len(t.split()) for t in texts)
    assert max(sizes.values()) <= words and sizes["parts"] <= words / 4
