import numpy as np
import pandas as pd
import xxhash

from loomgraph.llm import simhash
from loomgraph.llm.components import components

TEXTS = [None, "", " \t\n", "One", "one two", "One TWO three", "one two three", "É é word here", "a b c d e f g " * 2000] + ["copy of a text with several words in it"] * 40


def brute_fingerprint(text, k=3):
    words = [w for w in bytes(text or "", "utf-8").lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_classes_are_brute_force_s(spark):
    random = np.random.default_rng(2)
    texts = list(TEXTS)
    for _ in range(60):
        words = [f"w{random.integers(0, 50)}" for _ in range(int(random.integers(1, 300)))]
        texts.append(" ".join(words))
        for _ in range(int(random.integers(0, 4))):
            words[int(random.integers(0, len(words)))] = "changed"
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, id int, fp int").repartition(5)
    got = {r.id: r for r in simhash.classes(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == fps
    want = brute_components(fps)
    assert [got[i].component for i in range(len(texts))] == want
    twice = docs.union(docs.where("doc_id < 30"))
    kept = sorted(r.doc_id for r in simhash.survivors(simhash.classes(twice), twice).collect())
    assert kept == sorted(set(want))


def test_every_near_pair_links(spark):
    random = np.random.default_rng(4)
    fps = set()
    for _ in range(150):
        base = int(random.integers(0, 1 << 62))
        fps.add(base)
        for _ in range(int(random.integers(0, 6))):
            near = base
            for bit in random.choice(64, int(random.integers(0, 5)), replace=False):
                near ^= 1 << int(bit)
            fps.add(near)
    fps |= {7 ^ (1 << b) for b in range(64)}  # many meet at one variant
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame(pd.DataFrame({"fp": np.array(signed, dtype=np.int64)}))
    pairs = simhash.links(table)
    assert pairs.where("bit_count(a ^ b) > 3").count() == 0
    roots = {r.node: r.root for r in components(pairs).collect()}
    groups, want = {}, {}
    for i, (s, root) in enumerate(zip(signed, brute_components(fps))):
        groups.setdefault(roots.get(s, s), set()).add(i)
        want.setdefault(root, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (7, 8), (8, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (t.lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def test_edited_copies_are_similar(spark):
    random = np.random.default_rng(9)
    vocabulary = [f"w{i:04d}" for i in range(3000)]
    texts, origin = [None, "", "one", "One", "two words"], [0, 0, 2, 2, 4]
    for k in range(60):
        words = random.choice(vocabulary, int(random.integers(120, 600))).tolist()
        first = len(texts)
        texts.append(" ".join(words))
        origin.append(first)
        for _ in range(int(random.integers(0, 4))):
            edited = list(words)
            for at in random.integers(0, len(words), max(1, len(words) // 70)):
                edited[int(at)] = "changed"
            texts.append(" ".join(edited))
            origin.append(first)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bits string").repartition(4)
    got = {r.id: r.component for r in simhash.similar(docs).collect()}
    assert len(got) == len(texts)
    wrong = [i for i in range(len(texts)) if got[i] != origin[i]]
    alike = [i for i in range(len(texts)) if origin[i] != i and jaccard(texts[i] or "", texts[origin[i]] or "") >= 0.8]
    assert len(alike) > 60 and len(set(wrong) & set(alike)) <= len(alike) // 50  # bits are a sample: all but a few of a hundred
    kept = sorted(r.doc_id for r in simhash.survivors(simhash.similar(docs), docs).collect())
    assert kept == sorted(set(got.values()))
    assert simhash.similar(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_told_apart(spark):
    random = np.random.default_rng(10)
    a, b, c = (" ".join(random.choice([f"w{i}" for i in range(500)], 60)) for _ in range(3))
    rows = [(1, a), (2, b), (2, a), (3, c), (3, b + " x"), (None, c), (None, "alone here"), (4, None), (5, ""), (6, c), (6, c), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for found in (simhash.similar(docs), simhash.classes(docs)):
        kept = [(r.doc_id, r.text) for r in simhash.survivors(found, docs).collect() if r.text != b + " x"]  # its fingerprint may be far
        assert sorted(kept, key=str) == sorted([(1, a), (2, b), (3, c), (None, "alone here"), (4, None), (7, "twice")], key=str)


def block_edits(random, vocabulary):
    """Word lists with a block replaced, appended or cut off, at similarities on both sides of 0.8: (words, edited)."""
    for n in (12, 60, 200, 411):
        for size in sorted({1, 2, *(int(n * x) for x in (0.04, 0.06, 0.085, 0.1, 0.15, 0.2, 0.24, 0.26, 0.3))} - {0}):
            words = random.choice(vocabulary, n).tolist()
            new, at = random.choice(vocabulary, size).tolist(), int(random.integers(0, n - size))
            yield words, words[:at] + new + words[at + size :]
            yield words, words + new
            yield words, words[: n - size]


def test_every_alike_pair_shares_a_key(spark):
    random = np.random.default_rng(12)
    vocabulary = [f"w{i:04d}" for i in range(3000)]
    pairs = [(" ".join(a), " ".join(b)) for a, b in block_edits(random, vocabulary)]
    some = [t for p in pairs[::3] for t in p]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(some * 2)], "id long, text string").selectExpr("id", "0L as t", "cast(text as binary) text")
    common_ones, seen = simhash._common_shingles(docs)
    assert len(common_ones) and (np.diff(common_ones.astype(object)) > 0).all() and seen.min() >= simhash.SEEN
    for order in ((common_ones, seen), (common_ones[:0], seen[:0])):
        alike = 0
        for a, b in pairs:
            if jaccard(a, b) >= 0.8:
                alike += 1
                keys = [simhash.prefix(simhash.shingled(t.encode())[1], *order) for t in (a, b)]
                assert len(np.intersect1d(*keys))
        assert 50 < alike < len(pairs)


def test_alike_texts_are_brute_force_s(spark, monkeypatch):
    random = np.random.default_rng(13)
    vocabulary = [f"w{i:04d}" for i in range(3000)]
    texts = [None, "", "one", "One", "two words"]
    for words, edited in block_edits(random, vocabulary):
        texts += [" ".join(words), " ".join(edited)]
    for _ in range(40):  # scattered edits, most of them below 0.8
        words = random.choice(vocabulary, 200).tolist()
        texts.append(" ".join(words))
        for at in random.choice(200, int(random.integers(3, 9)), replace=False):
            words[int(at)] = "changed"
        texts.append(" ".join(words))
    line, template = random.choice(vocabulary, 30).tolist(), random.choice(vocabulary, 150).tolist()
    texts += [" ".join(line + random.choice(vocabulary, int(random.integers(2, 60))).tolist()) for _ in range(60)]
    for _ in range(80):  # a crowded template
        words = list(template)
        for at in random.choice(150, int(random.integers(1, 12)), replace=False):
            words[int(at)] = str(random.integers(0, 3000))
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = [find(i) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for rows in (simhash.GROUP_ROWS, 16):  # in one part and in parts
        monkeypatch.setattr(simhash, "GROUP_ROWS", rows)
        got = {r.id: r.component for r in simhash.similar(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_duplicates_join_the_links_of_fingerprints_and_of_shingles(spark):
    random = np.random.default_rng(14)
    vocabulary = [f"w{i:04d}" for i in range(3000)]
    texts = [None, "", " \n", "one", "One", "two words"]
    for times in (3, 5, 8, 200):  # a refrain outweighs the rest: near fingerprints, few equal shingles
        for _ in range(6):
            refrain = random.choice(vocabulary, 7).tolist() * times
            for _ in range(2):
                texts.append(" ".join(refrain + random.choice(vocabulary, 4 * int(random.integers(1, 4))).tolist()))
    for n in (60, 120, 300):  # a chain of small edits: alike shingles, far fingerprints
        for _ in range(6):
            words = random.choice(vocabulary, n).tolist()
            for _ in range(3):
                texts.append(" ".join(words))
                words = words[: -n // 20] + random.choice(vocabulary, n // 20).tolist()
    refrain, tail = random.choice(vocabulary, 7).tolist() * 40, random.choice(vocabulary, 60).tolist()
    texts += [" ".join(refrain), " ".join(refrain + tail[:55]), " ".join(refrain + tail)]  # one link of each kind, or of both
    fps = [brute_fingerprint(t) for t in texts]
    root, kinds = list(range(len(texts))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            near, alike = (fps[i] ^ fps[j]).bit_count() <= 3, jaccard(texts[i] or "", texts[j] or "") >= 0.8
            kinds.setdefault((near, alike), []).append((fps[i] ^ fps[j]).bit_count())
            if near or alike:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert min(len(kinds[k]) for k in ((True, False), (False, True), (True, True))) > 4 and max(kinds[True, False]) > 0
    want = [find(i) for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, fp int, g int").repartition(4)
    got = {r.id: r for r in simhash.duplicates(docs).collect()}
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == fps
    assert [got[i].component for i in range(len(texts))] == want
    assert len({r.root for r in got.values()}) == len(set(want))
    assert simhash.duplicates(docs.limit(0)).count() == 0
    # rows that repeat an id or have none stay or go each for itself
    odd = spark.createDataFrame([(1, texts[-1]), (2, texts[-2]), (2, "alone"), (None, texts[-1]), (None, "alone too"), (3, "alone"), (4, None), (None, "")], "doc_id long, text string")
    kept = [tuple(r) for r in simhash.survivors(simhash.duplicates(odd), odd).collect()]
    assert sorted(kept, key=str) == sorted([(1, texts[-1]), (2, "alone"), (None, "alone too"), (4, None)], key=str)
