"""Vector codes, near-duplicate vectors and the filter audit against plain versions: nulls, ties, repeated and no rows, clashing names."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from millrace.llm import filter_audit, vector_codes, vector_near_dup

VECTORS = "vec_id bigint, embedding array<float>, label int, whole string, n int, c string, id string, v string, node int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, "y", "z", "w", 2) for i, v, l in rows], VECTORS).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_codes(rows, entries, rounds, parts):
    kept = [
        (i, [math.floor(1024 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[nearest(p, c[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(held[j]) for x in zip(*held[j])] if j in held else e for j, e in enumerate(books[p])]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors, total = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for (_, _, l), e in zip(kept, errors):
        total[l] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), e, total[l], digest) for (i, _, l), f, e in zip(kept, found, errors)), key=repr)


def float32(values):
    return [float(np.float32(x)) for x in values]


def test_codes_are_those_of_all_distances(spark):
    r = random.Random(4)
    rows = [(i, float32(r.gauss(0, 0.1) for _ in range(12)), r.choice([0, 0, 0, 1, None])) for i in range(90)]
    rows += [(i + 90, float32(r.choice([0, 0.01]) for _ in range(12)), 5) for i in range(30)]  # ties
    rows += [(7, rows[7][1], 0), (7, rows[8][1], 1), (None, rows[3][1], 0), (300, None, 1), (301, [NAN] * 12, 1), (302, [INF] + [0.0] * 11, 1)]
    rows += [(303, [None] + [0.0] * 11, 1), (304, [-0.0] * 12, 1), (-1, [-9000.5] * 12, 2)]
    for entries, rounds in ((16, 4), (256, 2), (1, 1)):
        assert rows_of(vector_codes.compress(frame(spark, rows), entries, rounds)) == plain_codes(rows, entries, rounds, 4)
    out = vector_codes.compress(frame(spark, [(1, None, 1), (2, [NAN] * 4, 1)]))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    assert [(r.code, r.error) for r in vector_codes.compress(frame(spark, [(1, [], 1), (2, [], None)])).collect()] == [("00000000", 0)] * 2
    for bad in ([(1, [0.0] * 3, 1)], [(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)], [(1, [1e9] * 4, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(frame(spark, bad))


def test_bounds_rule_out_most_and_no_nearest():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (256, 16))
    points = centres[rng.integers(0, 256, 3000)] + rng.integers(-40, 40, (3000, 16))
    books = vector_codes.Codebooks(centres[None], 8)
    there = vector_codes.distances(centres, books.pivots[0])
    index, best, evaluated = vector_codes.nearest_entries(points, books.reach(points[:, None])[:, 0], centres, there)
    square = ((points[:, None].astype(object) - centres[None]) ** 2).sum(axis=2)
    assert (index == square.argmin(axis=1)).all() and (best == square.min(axis=1)).all()
    assert evaluated < 0.1 * len(points) * 256


def plain_near(rows, cosine):
    held = [
        k for k, (_, v, l) in enumerate(rows)
        if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    unit = {k: np.array([x / max(map(abs, rows[k][1])) for x in rows[k][1]]) for k in held}
    near = defaultdict(set)
    for i in held:
        for j in held:
            a, b = unit[i], unit[j]
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= cosine * math.sqrt((a @ a) * (b @ b)):
                near[i].add(j)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            more = near[todo.pop()] - seen
            seen |= more
            todo += more
        known = [rows[s][0] for s in seen if rows[s][0] is not None]
        least = min(known) if known else None
        out.append((i, len(near[k]), least, i is not None and i == least))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(8)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(20)
        for _ in range(40 if c else 120):
            v = centre + rng.standard_normal(20) * rng.choice([0.02, 0.15, 0.4])
            rows.append((len(rows), float32(v * rng.choice([1, 1, 3])), int(c % 2)))
    rows += [(900 + k, rows[3][1], 0) for k in range(30)] + [(5, rows[200][1], 1), (5, rows[1][1], 0), (None, rows[2][1], 0), (None, float32(rng.standard_normal(20)), 0)]
    rows += [(950, None, 0), (951, [0.0] * 20, 0), (952, [NAN] * 20, 0), (953, [None] * 20, 0), (954, rows[0][1], None), (955, rows[0][1], 1), (956, [INF] * 20, 0)]
    rows += [(960, [1.0, 2.0], 0), (961, [2.0, 4.0], 0), (962, [1.0], 0), (963, [5.0], 0), (964, [], 0), (965, [1e38] * 20, 3), (966, [2e38] * 20, 3), (967, [1e-40] * 20, 3)]
    return rows


@pytest.mark.parametrize("node_limit", [1024, 16])
def test_near_vectors_are_those_of_all_pairs(spark, clusters, node_limit):
    found = vector_near_dup.near_duplicates(frame(spark, clusters), node_limit=node_limit)
    assert rows_of(found) == plain_near(clusters, 0.98)


def test_wide_and_no_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(600)
    rows = [(k, float32(centre + rng.standard_normal(600) * (0.14 if k % 2 else 2)), 1) for k in range(40)]
    assert rows_of(vector_near_dup.near_duplicates(frame(spark, rows), node_limit=4)) == plain_near(rows, 0.98)
    assert vector_near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_rotation_keeps_lengths():
    for width in (1, 20, 600):
        x = np.random.default_rng(1).standard_normal((5, width))
        assert np.allclose((vector_near_dup.rotated(x) ** 2).sum(axis=1), (x**2).sum(axis=1))


DOCS = "doc_id bigint, text string, lang string, source string, mask int, h string, part string, n int, good int, id string, first string"


def plain_masks(docs):
    masks = []
    for i, t, part in docs:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        repeat = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            any(c in "#$%&*|" for c in t), repeat,
        ]
        masks.append((part or "", fails, i))
    return masks


def plain_audit(docs, labels):
    good, toxic = ({i for i, *f in labels if i is not None and f[k] == 1} for k in (0, 1))
    out = []
    masks = plain_masks(docs)
    for part in {m[0] for m in masks}:
        rows = [m for m in masks if m[0] == part]
        shapley, steps = defaultdict(int), []
        for order in permutations(range(5)):
            left, gone = rows, []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(removed)
                steps.append((
                    f, "".join("ABCDE"[k] for k in order), step, len(left), len(removed), sum(r[1][f] for r in gone),
                    sum(r[1][f] and sum(r[1]) == 1 for r in rows), sum(r[2] in good for r in removed), sum(r[2] in toxic for r in removed),
                ))
                gone = gone + removed
        out += [(part, *s[1:], shapley[s[0]]) for s in steps]
    return sorted(out, key=repr)


def test_audit_goes_through_all_orders(spark):
    r = random.Random(6)
    words = [f"w{k}é" for k in range(150)] + ["LOUD", "Aa", "#", "50%"]
    docs = []
    for k in range(120):
        if k % 4 == 3:
            docs.append((r.randint(0, 130), r.choice(docs)[1], r.choice(["de", "en", None])))
        else:
            text = r.choice([" ", "\n", "\t \x0b"]).join(r.choice(words[: r.choice([20, 154])]) for _ in range(r.choice([5, 99, 100, 130])))
            docs.append((k, text, r.choice(["de", "en", None, ""])))
    docs += [(500, None, "fr"), (501, "", "fr"), (None, docs[0][1], "de"), (None, docs[0][1], "de"), (502, "  a b " * 60, "fr"), (503, "x " * 40_000 + "|", "fr")]
    docs += [(0, docs[0][1], "de")] * 2 + [(504, docs[0][1], "en")] * 40 + [(600, f"one id {k}", "en") for k in range(60)]
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(0, 130, 2)] + [(1, None, 1), (1, 1, None), (600, 1, 1), (504, 0, 1), (None, 1, 1), (9999, 1, 1)]
    frame_ = spark.createDataFrame([(i, t, p, "s", 1, "h", "p", 2, 3, "i", "f") for i, t, p in docs], DOCS).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert rows_of(filter_audit.audit(frame_, marks)) == plain_audit(docs, labels)
    assert filter_audit.audit(frame_.limit(0), marks).count() == 0
    bare = rows_of(filter_audit.audit(frame_, marks.limit(0)))
    assert bare == plain_audit(docs, [])


def test_shares_are_exact_and_add_up():
    r = random.Random(1)
    counts = [r.randint(0, 10**12) for _ in range(32)]
    gone = filter_audit.coalitions(counts)
    assert gone == [sum(c for m, c in enumerate(counts) if m & s) for s in range(32)]
    shares = filter_audit.weighted_shares(gone)
    total = [0] * 5
    for order in permutations(range(5)):
        held = 0
        for f in order:
            total[f] += gone[held | 1 << f] - gone[held]
            held |= 1 << f
    assert [s * 120 for s in shares] == total and sum(shares) == gone[31]


def test_extra_columns_of_any_name_stay(spark):
    from millrace.llm import near_dup, secret_scan

    names = ["_id", "_asked", "_spans", "_n", "_c", "_gone", "_key", "_row", "_ID2", "c", "key"]
    text = "one two three four five six " * 3
    rows = [(1, "password=hunter2hunter2", *names), (2, text, *names), (3, text, *names), (3, "a b", *names), (None, "lone text", *names), (None, "lone text", *names)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns and all(tuple(r)[2:] == tuple(names) for r in clean.collect())
    assert sorted(r.text for r in clean.collect()) == sorted(["[SECRET]", text, text, "a b", "lone text", "lone text"])
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns and all(tuple(r)[2:] == tuple(names) for r in kept.collect())
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "lone text"), (1, "password=hunter2hunter2"), (2, text)]


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """One id holds a third of the rows; at most the documented number of texts is learned from."""
    from millrace.llm import language_id, pu_quality

    words = ["alpha beta gamma", "Haus Baum Garten", "le chat noir"]
    rows = [(k if k % 3 else -7, f"{words[k % 3]} number {k} " * 3, "ab"[k % 2]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(k, 1) for k in range(600) if k % 3] + [(-7, 1)], "doc_id bigint, quality int")
    sizes = []
    monkeypatch.setattr(pu_quality, "fit", lambda p, u: sizes.extend([len(p), len(u)]))
    pu_quality.train(docs, labels, positives=50, unlabelled=80)
    assert sizes == [50, 80]
    monkeypatch.setattr(language_id, "fit", lambda bags, y, languages, totals: sizes.extend(np.bincount(y).tolist()))
    language_id.train(docs, per_language=30)
    assert sizes[2:] == [30, 30]


def test_vectors_of_many_widths_are_all_searched(spark):
    from millrace.llm import vp_search

    rows = [(2 * w + k, [1.0] * (w - 1) + [float(k + 1)], 0) for w in range(1, 4200) if w < 40 or w > 4190 for k in range(2)]
    rows += [(100_000 + w, [1.0] * 3, 0) for w in range(30)]
    vectors = frame(spark, rows)
    found = vp_search.nearest(vectors, vectors, k=1)
    assert found.count() == len(rows)
