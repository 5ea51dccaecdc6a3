"""Against all pairs."""

import random

import pytest

from gridloom.llm.jaccard import band, jaccard_groups


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    ids = [i if i is not None else 2**63 for i, _ in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                top[find(a)] = find(b)
    least = {}
    for a in range(len(rows)):
        least[find(a)] = min(least.get(find(a), ids[a]), ids[a])
    none = lambda x: None if x == 2**63 else x
    return sorted(((rows[a][0], len(sets[a]), none(least[find(a)]), links[a]) for a in range(len(rows))), key=repr)


def made(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows, i = [], 10
    for size in (1, 2, 3, 8, 11, 14, 25, 60, 61, 130, 400):
        first = [r.choice(vocab) for _ in range(size)]
        for _ in range(12):
            w = list(first)
            for _ in range(r.randint(0, max(1, size // 30))):
                p = r.randrange(len(w))
                w[p] = r.choice(vocab).upper()
            if r.random() < 0.3:
                w += [r.choice(vocab)] * r.randint(1, 2)
            rows.append((i, " ".join(w)))
            i += 1
    r.shuffle(rows)
    return rows + [(1, None), (2, ""), (3, " \n"), (None, "alone here now and then"), (None, "alone here now and then"), (rows[0][0], rows[0][1]), (rows[1][0], rows[2][1])]


@pytest.mark.parametrize("n,percent,common", [(3, 90, 100), (5, 80, 100), (5, 80, 2), (3, 90, 2), (3, 80, 3)])
def test_same_as_all_pairs(spark, n, percent, common, monkeypatch):
    import gridloom.llm.jaccard as j

    monkeypatch.setattr(j, "BLOCK_SETS", 5)  # families over several blocks
    monkeypatch.setattr(j, "COMMON", common)
    rows = made(n)
    df = spark.createDataFrame([(i, t, "c", b"z") for i, t in rows], "doc_id long, text string, family string, node binary").repartition(3)
    got = jaccard_groups(df, n=n, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, n, percent)


def test_other_keys_and_huge_sets(spark):
    """String keys, the largest key beside null ones, and texts that are one huge set each."""
    r = random.Random(3)
    rows = made(4)
    df = spark.createDataFrame([(None if i is None else f"k{i}", t, 1, "x") for i, t in rows], "doc_id string, text string, x int, node string")
    got = jaccard_groups(df, n=3, percent=90).collect()
    number = {None if i is None else f"k{i}": i for i, _ in rows}
    want = brute(rows, 3, 90)
    groups = lambda pairs: {tuple(sorted(v, key=repr)) for v in pairs.values()}
    a, b = {}, {}
    for x in got:
        a.setdefault(x["component_id"], []).append((number[x["doc_id"]], x["n_shingles"], x["n_links"]))
    for i, m, c, links in want:
        b.setdefault(c, []).append((i, m, links))
    assert groups(a) == groups(b)
    big = [f"w{r.randrange(10**9)}" for _ in range(60_000)]
    edge = [(2**63 - 1, " ".join(big)), (None, " ".join(big[:59_000])), (5, " ".join(big[::-1])), (2**63 - 1, "a b c d"), (None, "a b c d")]
    df = spark.createDataFrame(edge, "doc_id long, text string")
    assert sorted((tuple(x) for x in jaccard_groups(df, n=3, percent=90).collect()), key=repr) == brute(edge, 3, 90)


@pytest.mark.parametrize("hubs,most", [(5, 20), (1000, 200_000)])
def test_components_with_hubs(spark, monkeypatch, hubs, most):
    import gridloom.llm.components as c

    monkeypatch.setattr(c, "HUBS", hubs)
    monkeypatch.setattr(c, "HUB_EDGES", most)
    r = random.Random(1)
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(250)] + [(7, 7), (0, 1)]
    top = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        top[max(find(a), find(b))] = min(find(a), find(b))
    got = c.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["node"]: x["root"] for x in got} == {x: find(x) for e in edges if e[0] != e[1] for x in e} and len(got) == len({x["node"] for x in got})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_groups(df).count() == 0


def test_links_reach_over_two_bands(spark):
    """60 percent links sets of 6 and 10 words, whose bands are two apart."""
    small, large = " ".join(f"w{i}" for i in range(6)), " ".join(f"w{i}" for i in range(10))
    assert band(10) - band(6) == 2
    rows = spark.createDataFrame([(1, small), (2, large), (3, "other words only")], "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in jaccard_groups(rows, n=1, percent=60).collect()}
    assert got[1] == got[2] != got[3]
