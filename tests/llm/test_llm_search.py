"""Nearest neighbours, image copies, secret scan, pipeline."""

import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from conftest import SMALL  # noqa: E402
from choicefield.llm import ann, media, pii, queries, secret_scan  # noqa: E402


def exact(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            near = sorted((-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_neighbours_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want, got = exact(rows), {}
    for r in queries.op8_ann(spark, SMALL).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({j for j, _ in want[q]} & {j for _, j, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vectors = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        assert [r for r, *_ in sorted(found)] == list(range(1, 6))
        for _, j, s in found:
            a, b = vectors[q], vectors[j]
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_neighbours_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(1, 60)] + [(i, [1.0, 2.0, 0.0, 0.0]) for i in range(100, 160)]
    rows += [(0, None), (200, [0.0] * 4), (250, [1.0, None, 1.0, 1.0]), (300, [float("nan")] * 4), (350, [float("inf")] * 4), (400, []), (None, [1.0] * 4), (50, rows[49][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {}
    for r in ann.search(frame, frame.vec_id % 50 == 0).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(list(dict.fromkeys((i, tuple(v) if v is not None else None) for i, v in rows)))
    assert out.keys() == want.keys() == {50, 100, 150}
    for q, near in want.items():
        assert [j for _, j, _ in sorted(out[q])] == [j for j, _ in near]
    assert ann.search(frame.limit(0), frame.vec_id % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(few, few.vec_id % 50 == 0).collect()] == [(0, 1, 1, 0.0)]


def test_scan_abandons_none_of_the_nearest():
    rng = np.random.default_rng(2)
    x, c = ann.units(rng.standard_normal((20, 64))), ann.units(rng.standard_normal((9000, 64)))
    q, j = ann.scan(x, c, np.linalg.qr(rng.standard_normal((64, 64)))[0], 6)
    want = np.argsort(-(x @ c.T), axis=1)[:, :6]
    assert np.mean([len(set(want[i]) & set(j[q == i])) / 6 for i in range(20)]) > 0.97


def test_image_copies(spark):
    drawings = media.drawings(spark.read.parquet(f"{SMALL}/embeddings.parquet").limit(150)).cache()
    rows = media.image_copies(drawings).collect()
    origin = {r.media_id: r.origin for r in drawings.collect()}
    assert {r.media_id: r.copy_id for r in rows} == origin and any(i != o for i, o in origin.items()) and all(r.n_corners > 8 for r in rows)


def test_image_odd_rows(spark):
    image = media.write_pgm(media.drawn(np.arange(64.0) % 7))
    flat = media.write_pgm(np.full((50, 50), 9.0))
    rows = [(1, None, 0), (2, b"", 0), (3, b"P5 x", 0), (4, b"P5\n9 9\n255\n123", 0), (5, image, 0), (6, image, 0), (6, image, 0), (7, flat, 0), (8, flat, 0), (9, media.write_pgm(np.ones((3, 3))), 0)]
    out = media.image_copies(spark.createDataFrame(rows, "media_id long, image binary, copy_id int")).collect()
    assert Counter((r.media_id, r.copy_id) for r in out) == Counter([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (6, 5), (7, 7), (8, 7), (9, 9)])
    assert media.image_copies(spark.createDataFrame([], "media_id long, image binary")).count() == 0


def test_secret_scan_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = secret_scan.findings(docs, secret_scan.corpus_of(docs)).cache()
    held = found.filter("doc_id % 3 = 0")
    kept = {(r.doc_id, r.start) for r in secret_scan.scan(held, secret_scan.train(found.filter("doc_id % 3 <> 0"), label="weak")).collect()}
    rows = held.collect()
    assert rows and np.mean([(r.weak == 1) == ((r.doc_id, r.start) in kept) for r in rows]) >= 0.95


def test_secret_scan_odd_rows(spark):
    key = "AKIA" + "Q7Z2" * 4
    frame = spark.createDataFrame([(1, None, None, 0), (2, "", "s", 0), (3, f"x {key} y", None, 0), (3, f"x {key} y", None, 0), (None, "password = 'ab12cd34ef'", "a/b.py", 0)],
                                  "doc_id long, text string, source string, start int")
    corpus = secret_scan.corpus_of(frame)
    found = secret_scan.findings(frame, corpus)
    assert Counter((r.doc_id, r.start, r.end, r.weak) for r in found.collect()) == Counter([(3, 2, 22, 1), (3, 2, 22, 1), (None, 12, 22, 1)])
    assert secret_scan.train(found, label="weak") is None and secret_scan.scan(found, None).count() == 3
    assert secret_scan.findings(frame.limit(0), secret_scan.corpus_of(frame.limit(0))).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], SMALL).cache())
        assert steps[-1].columns == docs.columns
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps]
    assert len(texts[1]) >= 0.98 * len(texts[0])
    groups = brute.components(list(texts[1].items()))
    assert set(texts[2]) == {d for d, n, c in groups if d == c or not n}
    assert set(texts[3]) == set(texts[2]) and all(t == pii.redacted_text(texts[2][d]) for d, t in texts[3].items())
    assert not any(pii.base_spans(t) for t in texts[3].values())
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == set(texts[3])
