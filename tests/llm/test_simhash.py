import random

import numpy as np
import pytest

from eventlab.llm.simhash import near_duplicates, text_node, components, fingerprint, links, simhash_components


def brute(rows):
    """rows: (doc_id, text) -> {(doc_id, fingerprint, component_id)}, all pairs compared."""
    fps = [fingerprint(None if t is None else t.encode(), 4) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.nonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 4)[0]:
            root[find(i + 1 + int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def slow_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "ÄÖ a B\tc\x0bd e", "x " * 70_000, "a b c d a b c d"])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode(), 4) == slow_fingerprint(text)


def test_native_hash_is_the_same(spark):
    from pyspark.sql import functions as F
    import xxhash

    got = spark.range(1).select(F.xxhash64(F.lit("das ist ein satz"))).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"das ist ein satz", 42)


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(8):
            x = base
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = [x - 2**64 if x >= 2**63 else x for x in fps]
    for tau in (4, 3, 0):
        want = sorted((min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= tau)
        got = sorted(map(tuple, links(spark.createDataFrame([(x,) for x in fps], "fp long"), tau).collect()))
        assert got == want  # and each link once


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (200, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 300: 200}


def test_query_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, simhash_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (9, "only"), (None, "alone here")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, component_id long")
    assert sorted(map(tuple, simhash_components(df).collect()), key=str) == brute(rows)
    assert simhash_components(df.limit(0)).count() == 0


def sets_of(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def groups_of(rows, least=0.8):
    """rows: (doc_id, text) -> the least text of each text's group, by all pairs."""
    texts = sorted({t or "" for _, t in rows})
    sets, root = {t: sets_of(t) for t in texts}, {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {t: find(t) for t in texts}


def found_groups(spark, rows):
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, node int, key string")
    roots = {r.node: r.root for r in near_duplicates(df).collect()}
    nodes = df.select("text", text_node(df.text).alias("at")).collect()
    return {r.text or "": roots.get(r["at"], r["at"]) for r in nodes}


def test_near_duplicates_of_every_similarity(spark):
    """Copies with some words changed, from just under 0.8 to 1: no false link, and links of 0.8 and more are found."""
    import random

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, links = [], []
    for k in range(60):
        base = [word() for _ in range(rng.choice([60, 150, 400]))]
        rows.append((len(rows), " ".join(base)))
        for part in (0.01, 0.02, 0.03):
            other = list(base)
            for at in rng.sample(range(len(base)), max(1, round(part * len(base)))):
                other[at] = word()
            rows.append((len(rows), " ".join(other)))
            x, y = sets_of(rows[-1][1]), sets_of(" ".join(base))
            if len(x & y) >= 0.8 * len(x | y):
                links.append((" ".join(base), rows[-1][1]))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c"), (906, "x " * 4000), (907, "x " * 4100), (None, rows[0][1]), (908, rows[0][1].upper())]
    have, want = found_groups(spark, rows), groups_of(rows)
    for a in have:  # found groups lie within the exact ones
        for b in have:
            assert have[a] != have[b] or want[a] == want[b]
    assert len(links) > 100 and sum(have[a] == have[b] for a, b in links) >= 0.97 * len(links)


def test_a_large_group_of_near_copies_is_a_star(spark):
    import random

    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(1500):
        other = list(base)
        other[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(other)))
    assert len(set(found_groups(spark, rows).values())) == 1


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_without_common_shingles_do_not_meet():
    """Keys of different texts are never equal by chance, however many texts there are; equal and near ones share keys."""
    from eventlab.llm.simhash import sketch

    rng = np.random.default_rng(4)
    sets = rng.integers(0, 2**64, (5000, 60), np.uint64)
    keys = np.array([sketch(s)[0] for s in sets])
    assert len(np.unique(keys)) == keys.size
    other = sets.copy()
    other[:, :6] = rng.integers(0, 2**64, (5000, 6), np.uint64)  # 54 of 66: 0.818
    near = [sketch(s) for s in other]
    assert sum((k == x[0]).any() for k, x in zip(keys, near)) >= 0.995 * 5000


def test_a_group_just_under_the_threshold_makes_no_rows(spark):
    """Near copies of which many pairs are just under 0.8: groups are those of all pairs, and what is compared last comes out as links only."""
    from eventlab.llm import simhash

    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = []
    for i in range(400):
        other = list(base)
        for at in rng.sample(range(100), rng.choice([1, 1, 2, 4])):
            other[at] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(other)))
    sizes = {}
    plain = simhash.cut

    def counted(df, name="t"):
        out = plain(df, name)
        sizes[name] = max(out.count(), sizes.get(name, 0))
        return out

    simhash.cut = counted
    try:
        have = found_groups(spark, rows)
    finally:
        simhash.cut = plain
    want = groups_of(rows)
    assert {frozenset(t for t in have if have[t] == r) for r in have.values()} == {frozenset(t for t in want if want[t] == r) for r in want.values()}
    assert max(sizes.values()) <= 400 * simhash.BANDS and sizes["last"] < 4000


def test_no_link_is_missed(spark):
    """Pairs at 0.8 exactly, of which three in 1,000 have no equal band, and a text between two of them; none just under 0.8."""
    rows, pairs = [], []
    for k in range(2000):
        words = [f"w{k}x{i}" for i in range(94)]
        other = words[:-10] + [f"v{k}x{i}" for i in range(10)]  # 80 of 100 shingles
        under = words[:-11] + [f"u{k}x{i}" for i in range(11)]  # 79 of 101
        pairs.append((" ".join(words), " ".join(other), " ".join(under)))
        rows += [(3 * k + j, t) for j, t in enumerate(pairs[-1])]
    have = found_groups(spark, rows)
    assert [k for k, (a, b, _) in enumerate(pairs) if have[a] != have[b]] == []
    assert [k for k, (a, b, c) in enumerate(pairs) if have[a] == have[c]] == []


def test_prefixes_and_parities_leave_out_no_link():
    """Sets at 0.8 or more have a key in common in their prefixes, in any order, and no more parities differ than shingles do."""
    from eventlab.llm.simhash import SLOTS, parities, prefix

    rng = np.random.default_rng(8)
    for k in range(3000):
        n = int(rng.integers(1, 400))
        classes = rng.integers(0, 64, SLOTS, np.uint64) if k % 2 else np.zeros(SLOTS, np.uint64)
        x = rng.integers(0, 2**64, n, np.uint64)
        gone = int(rng.integers(0, n // 9 + 1))
        y = np.r_[x[gone:], rng.integers(0, 2**64, int(rng.integers(0, max(1, (n - gone) / 0.8 - n + 1))), np.uint64)]
        common = n - gone
        if common < (0.8 - 1e-9) * (len(x) + len(y) - common):
            continue
        (k1, short1, needed1), (k2, short2, needed2) = (prefix(s, classes, 0.8) for s in (x, y))
        assert len(np.intersect1d(k1[:short1], k2[:short2])) and len(np.intersect1d(k1, k2)) >= max(needed1, needed2)
        off = int(np.bitwise_count((parities(x) ^ parities(y)).view(np.uint64)).sum())
        assert off <= len(x) + len(y) - 2 * common <= (len(x) + len(y)) / 9 + 1e-6
