import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import components as comp
from barloom.llm import jaccard
from barloom.llm.shingles import shingle_sets, word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, len(s), ids.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near(text, rnd, edits):
    w = text.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = rnd.choice("pqrstuvw") * 3
    return " ".join(w)


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    out = []
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 18, 25, 40, 80, 200, 600):
        for _ in range(3):
            base = " ".join(word() for _ in range(size))
            out += [base, base.upper() + "\n", base + " " + word(), base + " " + word() + " " + word()]
            out += [near(base, rnd, k) for k in (1, 1, 2, 5)]
    out += [passage + " " + " ".join(word() for _ in range(rnd.randrange(20, 120))) for _ in range(60)]
    hot = " ".join(word() for _ in range(150))
    out += [near(hot, rnd, 1) for _ in range(40)] + [hot] * 20
    out += [None, "", " \t", "one", "ONE", "a b", "A\tb"]
    rows = [(i * 2 + 3, t) for i, t in enumerate(out)]
    rnd.shuffle(rows)
    return rows + [(3, out[0]), (None, out[20]), (None, "lone null id here")]


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n_shingles int").repartition(6)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)


def test_equals_all_pairs(spark):
    rows = corpus()
    assert found(spark, rows) == expected(rows)


def test_equals_all_pairs_when_every_key_is_expensive(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 2)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
    rows = corpus(2)
    assert found(spark, rows) == expected(rows)


def test_sets_short_of_segments(spark, monkeypatch):
    # With hardly a segment to spare, sets need empty segments too.
    need = jaccard.most_apart(jaccard.BANDS[1:] - 1, jaccard.BANDS[1:] - 1) + 1
    tight = jaccard.Layout(np.where(need > 2, need, 0), np.where(need > 2, 0, 1))
    monkeypatch.setattr(jaccard, "LAYOUT", tight)
    rows = [r for r in corpus(3) if len(words(r[1])) < 30]
    assert found(spark, rows) == expected(rows)


def test_odd_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]
    assert found(spark, [(1, "a b"), (2, "a b"), (2, "a b")]) == [(1, 1, 1), (2, 1, 1), (2, 1, 1)]


def test_keys_miss_no_similar_pair():
    """The allocation's promise: whatever a set leaves out of what it can spare,
    one of its other keys meets each similar set."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(4, 120))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[: n - int(rng.integers(0, n // 7 + 1))], rng.integers(0, 1 << 62, int(rng.integers(0, n // 6 + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if not jaccard.similar(a, b) or np.array_equal(a, b):
            continue
        a, b = sorted((a, b), key=len)
        kept = None
        for ahead in (False, True):
            owner, key, flag, spare = jaccard.keys_of([a], ahead)
            other = jaccard.keys_of([b], False)
            home = lambda s: int(np.searchsorted(jaccard.BANDS, len(s), "right"))
            if home(a) + ahead != home(b) or spare[0] < 0:
                continue
            left = int(spare[0])
            order = rng.permutation(len(key))
            use = []
            for i in order:
                weight = 2 if flag[i] & jaccard.TWICE else 1
                if weight <= left:
                    left -= weight
                else:
                    use.append(i)
            theirs = {}
            for k, f in zip(other[1].tolist(), other[2].tolist(), strict=True):
                theirs.setdefault(k, []).append(bool(f & jaccard.LEFT_OUT))
            kept = any(not (flag[i] & jaccard.LEFT_OUT and less) for i in use for less in theirs.get(int(key[i]), []))
        assert kept in (None, True)


def test_common_elements(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 40))).astype(np.uint64)) for _ in range(30)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = jaccard.common(sets)
    np.fill_diagonal(got, 0)
    assert (got == np.array(want) * (1 - np.eye(30))).all()


def test_signature_is_a_lower_bound():
    rng = np.random.default_rng(6)
    for _ in range(100):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 3000))).astype(np.uint64))
        b = np.unique(np.concatenate([a[:: int(rng.integers(1, 4))], rng.integers(0, 1 << 62, 50).astype(np.uint64)]))
        assert jaccard.surely_apart(jaccard.signature(a), jaccard.signature(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("section", [7, 1 << 20])
def test_words_and_sets(monkeypatch, section):
    from barloom.llm import shingles as sh

    monkeypatch.setattr(sh, "SECTION", section)
    texts = ["A b", "", "a\tB ", "x" * 50, "a b c d e f", "a b c d e f a b c d e", "é É b"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    hashes, text = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert Counter(text.tolist()) == Counter({i: len(words(t)) for i, t in enumerate(texts) if words(t)})
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3]
    assert [len(s) for s in shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets)] == [len(shingles(t)) for t in texts]


def test_components(spark):
    rnd = random.Random(7)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 580)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(70)] + [(7, 7), (9, 8), (8, 9)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in comp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == nodes
    assert len({(find(n), got[n]) for n in nodes}) == len({find(n) for n in nodes}) == len(set(got.values()))
    assert comp.components(spark.createDataFrame([], "a long, b long")).collect() == []
