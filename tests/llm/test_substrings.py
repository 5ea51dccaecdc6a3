"""Against a plain scan over all windows."""

import random

import pytest

from gridloom.llm.substrings import Parse, dedup_substrings

N = 20


def brute(rows, hashes):
    """hashes: of each text, which order records of equal key."""
    seen, cover, words = set(), {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or type(rows[0][0])(), hashes[rows[i][1] or ""]))
    for i in order:
        w = (rows[i][1] or "").split()
        words[i], cover[i] = w, set()
        for p in range(len(w) - N + 1):
            g = tuple(w[p : p + N])
            if g in seen:
                cover[i].update(range(p, p + N))
            seen.add(g)
    return sorted(
        ((rows[i][0], len(w), len(cover[i]), " ".join(x for p, x in enumerate(w) if p not in cover[i])) for i, w in words.items()), key=repr
    )


def made(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    passage = [r.choice(vocab) for _ in range(70)]
    rows = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 80))]
        kind = i % 6
        if kind == 0:
            a = r.randint(0, 40)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + r.randint(15, 45)]
        elif kind == 1:
            w = ["x"] * r.randint(10, 70) + w
        elif kind == 2:
            w = ["a", "b"] * r.randint(5, 40)
        elif kind == 3 and rows:
            w = (rows[r.randrange(len(rows))][1] or "").split()
        rows.append((i, " ".join(w)))
    rows += [(60, None), (61, ""), (None, " ".join(passage)), (62, " \t\n"), (3, " ".join(passage)), (3, " ".join(passage)), (63, " ".join(passage * 40))]
    return rows


def check(spark, rows, kind="long", **how):
    df = spark.createDataFrame([(i, t, "x", 1, "y", b"z") for i, t in rows], f"doc_id {kind}, text string, piece string, bucket int, ord string, t binary").repartition(4)
    hashes = {r["s"]: r["h"] for r in df.selectExpr("coalesce(text, '') as s", "xxhash64(coalesce(text, '')) as h").distinct().collect()}
    got = dedup_substrings(df, **how).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, hashes)


@pytest.mark.parametrize("pieces,buckets,low,high", [(1, 1, 4, (14, 18)), (5, 3, 4, (5, 6, 7)), (4, 7, 2, (9, 10)), (3, 2, 7, (4, 22))])
def test_same_as_plain_scan(spark, pieces, buckets, low, high):
    check(spark, made(pieces), pieces=pieces, buckets=buckets, low=low, high=high)


def test_unique_keys_and_other_key_types(spark):
    r = random.Random(9)
    rows = [(k, t) for k, (_, t) in enumerate(made(9))] + [(2**63 - 1, "w1 " * 30), (-(2**63), "w1 " * 30), (-5, "w2 w1 " * 3000 + " ".join(f"u{i}" for i in range(50_000)))]
    check(spark, rows, pieces=6, buckets=4)
    check(spark, [(f"k{i}" if r.random() < 0.9 else None, t) for i, t in rows], "string", pieces=6, buckets=4)
    check(spark, [(2**63 - 1, "w1 " * 30), (None, "w1 " * 30), (2**63 - 1, "w1 " * 30)], pieces=2, buckets=2)


def test_names_of_windows_are_their_words(spark):
    """Equal names for equal windows, wherever they are, and for no others."""
    r = random.Random(4)
    for vocab in (2, 3, 30):
        texts = [" ".join(f"v{r.randrange(vocab)}" for _ in range(r.randint(20, 120))) for _ in range(40)]
        texts += [texts[0], "q " + texts[1], "v1 " * 50, "v1 v0 " * 30]
        for rounds in (1, 3, 22):
            p = Parse([t.encode() for t in texts], rounds=rounds)
            at = p.starts()
            flat = [w for t in texts for w in [*t.split(), None]]
            a, b = p.window_names(at)
            names = {}
            for i, x in zip(at.tolist(), zip(a.tolist(), b.tolist())):
                assert names.setdefault(x, tuple(flat[i : i + N])) == tuple(flat[i : i + N])
            assert len(names) == len({tuple(flat[i : i + N]) for i in at.tolist()})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(df).count() == 0
