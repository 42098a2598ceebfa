"""The filter audit, the vector codes and the fingerprints against brute force, on small tables with every odd case."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
import xxhash

from fieldtrust.llm import filter_audit, simhash, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, part string, mask int, piece long, fp long, node long"


def texts_of(rng, n):
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            own = list(out[rng.randrange(len(out))])
            if own and rng.random() < 0.5:
                own[rng.randrange(len(own))] = rng.choice("xyZ#")
            out.append("".join(own))
        elif rng.random() < 0.2:
            out.append("same words again and again " * rng.choice([5, 60, 200]) + str(i))
        else:
            out.append(" ".join(rng.choice(["Alpha", "beta", "GAMMA", "delta|", "eps", "漢字", "é"]) + str(rng.randint(0, 40 if i % 2 else 4000)) for _ in range(rng.choice([1, 3, 30, 260]))))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(i, t, rng.choice(["a", "b", None, ""]), "x", 1, 2, 3, 4) for i, t in enumerate(texts_of(rng, 150))]
    hot = out[5][1]
    out += [(i, hot, "b", "x", 1, 2, 3, 4) for i in range(200, 280)]
    out += [(300, None, "a", None, 1, 2, 3, 4), (301, "", "a", None, 1, 2, 3, 4), (302, " \n\t", "c", None, 1, 2, 3, 4), (303, "W" * 70_000, "c", None, 1, 2, 3, 4)]
    out += [out[7], (None, hot, "b", None, 1, 2, 3, 4), (None, None, None, None, 1, 2, 3, 4), (7, out[9][1], "a", None, 1, 2, 3, 4)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


LABELS = [(0, 1, 0), (5, 1, 1), (5, 0, 0), (200, 1, 0), (201, 0, 1), (7, 1, None), (999, 1, 1), (None, 1, 1), (301, None, 1)]


def audited(rows, labels):
    least, good, toxic = {}, set(), set()
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    for d, q, x in labels:
        if d is not None:
            good |= {d} if q == 1 else set()
            toxic |= {d} if x == 1 else set()
    failing = []
    for d, t, source, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {c for c, test in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)), ("D", re.search(r"[#$%&*|]", t)), ("E", d is not None and d > least[t])) if test}
        failing.append((source or "", f, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in failing}:
        own = [x for x in failing if x[0] == part]
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                shapley[c] += len(gone)
                left = [x for x in left if c not in x[1]]
                fails = [x for x in own if c in x[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(x[1] == {c} for x in fails), sum(x[2] for x in gone), sum(x[3] for x in gone), c]
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]] if isinstance(v[6], str) else v[6]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("window, trie", [(filter_audit.WINDOW_BYTES, filter_audit.TRIE_BYTES), (4000, 3000)])
def test_filter_audit(spark, rows, docs, window, trie):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, window, trie).collect()
    expected = audited(rows, LABELS)
    assert len(got) == len(expected) == 600 * 4
    for r in got:
        assert tuple(r)[3:] == expected[r.part, r.filter_order, r.step], r


def test_filter_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert filter_audit.audit(docs, labels.where("false")).agg({"good_lost": "sum"}).first()[0] == 0


def test_trie_of_nested_and_equal_texts():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    trie, least, where = filter_audit.Trie(), {}, defaultdict(list)
    for piece, t in enumerate(texts):
        doc = rng.choice([None, rng.randint(0, 99)])
        trie.insert(t, doc, piece)
        where[t].append(piece)
        if doc is not None:
            least[t] = min(least.get(t, doc), doc)
    assert dict(trie.shared()) == {p: least.get(t) for t, ps in where.items() if len(ps) > 1 for p in ps}


def test_heavy_prefixes_are_extended_and_equal_texts_keep_one_key(spark):
    """A third of the texts share 3,000 bytes: their ranges go by what follows, whatever its place."""
    shared = b"p" * 3000
    texts = [shared + str(i).encode() * 20 for i in range(60)] + [str(i).encode() * 50 for i in range(100)] + [shared] * 5
    rows = [(i, t, filter_audit.prefix_hashes(t)) for i, t in enumerate(texts)]
    keyed = filter_audit.with_range_key(spark.createDataFrame(rows, "piece long, text binary, steps array<long>"), 8).collect()
    of = defaultdict(set)
    for r in keyed:
        of[bytes(r.text)].add((bytes(r.p0), r.depth, r.h))
    assert all(len(x) == 1 for x in of.values())
    deep = [r for r in keyed if bytes(r.text).startswith(shared)]
    assert {r.depth for r in deep if len(r.text) > 3000} == {4} and len({r.h for r in deep}) == 61
    assert {r.depth for r in keyed if not bytes(r.text).startswith(shared)} == {0}


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long"


def brute_codes(rows, parts, entries, rounds):
    whole = [(v, l, np.floor(np.array(e, np.float64) * 1024).astype(np.int64)) for v, e, l, *_ in rows if e and None not in e and np.isfinite(e).all() and len(e) == 8]
    first = {}
    for v, e, *_ in rows:
        if v is not None and e and None not in e and np.isfinite(e).all() and len(e) == 8:
            first[v] = min(first.get(v, e), e)
    ids = sorted(first)[:entries]
    books = np.split(np.floor(np.array([first[v] for v in ids]) * 1024).astype(np.int64), parts, axis=1)
    cut = [np.split(x, parts) for _, _, x in whole]

    def assign(p):
        d = ((np.array([c[p] for c in cut])[:, None, :] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = assign(p)
            for k in set(at.tolist()):
                books[p][k] = [int(s) // int((at == k).sum()) for s in np.array([c[p] for c in cut])[at == k].sum(axis=0)]
    found = [assign(p) for p in range(parts)]
    error = sum(f[1] for f in found)
    total = defaultdict(int)
    for (_, l, _), e in zip(whole, error, strict=True):
        total[l] += int(e)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return sorted((str(v), "".join(f"{f[0][i]:02x}" for f in found), int(error[i]), str(l), total[l], digest) for i, (v, l, _) in enumerate(whole))


@pytest.mark.parametrize("entries, n", [(16, 300), (256, 60)])
def test_vector_codes(spark, entries, n):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(9)]
    f32 = lambda xs: [float(np.float32(x)) for x in xs]
    rows = [(i * 3 % 401, f32(c + rng.gauss(0, 0.1) for c in rng.choice(centres)), rng.choice([0, 1, None]), "x", 5) for i in range(n)]
    rows += [(1000 + i, f32([0.5] * 8), 2, "x", 5) for i in range(100)]
    bad = [None, [], [0.1] * 7 + [None], [0.1] * 7 + [float("nan")], [float("inf")] + [0.1] * 7, [0.1] * 12]
    rows += [(-5 + i if i < 5 else 2000, None if e is None else e, 1, "x", 5) for i, e in enumerate(bad)] + [rows[4], (None, rows[6][1], 0, "x", 5), (6, f32([-2.0] * 8), 0, "x", 5)]
    got = vector_codes.compressed(spark.createDataFrame(rows, VECTORS).repartition(3), entries=entries).collect()
    assert sorted((str(r.vec_id), r.code, r.error, str(r.label), r.label_error, r.codebooks_sha256) for r in got) == brute_codes(rows, 4, entries, 4)


def test_vector_codes_of_nothing(spark):
    out = vector_codes.compressed(spark.createDataFrame([(1, None, 1, "x", 5), (2, [float("nan")] * 8, 1, "x", 5)], VECTORS))
    assert out.columns == ["vec_id", "code", "error", "label", "label_error", "codebooks_sha256"] and out.count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compressed(spark.createDataFrame([(1, [0.0] * 6, 1, "x", 5)], VECTORS))


def test_orchard_search_equals_full_comparison_and_leaves_entries_out():
    rng = np.random.default_rng(2)
    for k, d, spread in ((64, 2, 50), (200, 3, 4), (40, 5, 1000), (1, 4, 10)):
        entries, rows = rng.integers(-spread, spread, (k, d)), rng.integers(-spread, spread, (3000, d))
        far = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
        seen = []
        at, best = vector_codes.nearest(vector_codes.Codebook.of(entries), rows, seen)
        assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
        if k == 64:
            assert sum(seen) < 0.6 * k * len(rows)


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOW))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile", [simhash.TILE, 7])
def test_simhash_groups(rows, docs, tile):
    fps = {i: brute_fingerprint(r[1]) for i, r in enumerate(rows)}
    own = {r[0]: r[0] for r in rows if r[0] is not None}
    named = [(r[0], fps[i]) for i, r in enumerate(rows) if r[0] is not None]
    changed = True
    while changed:
        changed = False
        for a, x in named:
            for b, y in named:
                if own[a] != own[b] and (x ^ y).bit_count() <= 4:
                    own[a] = own[b] = min(own[a], own[b])
                    changed = True
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_groups(docs, tile=tile).collect())
    assert got == sorted((str(r[0]), f"{fps[i]:016x}", str(own.get(r[0]))) for i, r in enumerate(rows))
    assert simhash.simhash_groups(docs.where("false")).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97} Q{i % 31}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES", 100)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


def test_tiles_join_all_components_with_few_links(spark):
    """Chains of neighbours and a dense ball in small tiles; links stay far fewer than close pairs."""
    rng = random.Random(6)
    middle = rng.getrandbits(64)
    fps = [middle ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a + 1)]
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(30):
            fps.append(x)
            x ^= 1 << rng.randrange(64)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.tiled_links(spark.createDataFrame(list(enumerate(signed)), "node long, fp long"), 4, 50).collect()
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 4 for r in links) and len(links) < len(near) / 10

    def groups(pairs):
        top = list(range(len(fps)))

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in pairs:
            top[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(len(fps))]

    assert groups(near) == groups([(r.a, r.b) for r in links])
