import random

import pytest

from millrace.operators import packing

CAP = 64


def first_fit(pieces):
    used, out = [], []
    for n in pieces:
        k = next((i for i, u in enumerate(used) if CAP - u >= n), None)
        if k is None:
            used.append(0)
            k = len(used) - 1
        out.append((k, used[k]))
        used[k] += n
    return out


def tightest(pieces):
    used, out = [], []
    for n in pieces:
        fits = [(CAP - u - n, i) for i, u in enumerate(used) if CAP - u >= n]
        k = min(fits)[1] if fits else len(used)
        if not fits:
            used.append(0)
        out.append((k, used[k]))
        used[k] += n
    return out


@pytest.mark.parametrize("seed", range(5))
def test_fits_against_brute_force(seed):
    r = random.Random(seed)
    pieces = [r.randrange(1, CAP + 1) for _ in range(300)]
    first, best = packing.FirstFit(CAP, len(pieces)), packing.BestFit(CAP)
    assert [first.place(n) for n in pieces] == first_fit(pieces)
    assert [best.place(n) for n in pieces] == tightest(pieces)


def test_cut_prefers_the_last_point_that_fits():
    assert packing.cut_at(150, [20, 60, 100], 64) == [(0, 60), (60, 40), (100, 50)]
    assert packing.cut_at(150, [], 64) == [(0, 64), (64, 64), (128, 22)]
    assert packing.cut_at(10, [5], 64) == [(0, 10)]


ITEMS = "doc_id long, lane string, size int, points array<int>, min_context int, reserved boolean"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    return spark.createDataFrame([(i, r.choice(["a", "a", "b"]), r.randrange(1, 200), sorted({r.randrange(2, 200) for _ in range(3)}), r.choice([0, 0, 300]), False) for i in range(120)], ITEMS)


@pytest.mark.parametrize("pack", [packing.greedy, packing.best_fit, packing.concat_chop])
def test_every_token_is_placed_once(rows, pack):
    placed = pack(rows, CAP).collect()
    size = {r["doc_id"]: r["size"] for r in rows.collect()}
    for doc, n in size.items():
        own = sorted((p["offset"], p["length"]) for p in placed if p["doc_id"] == doc)
        assert own[0][0] == 0 and sum(x for _, x in own) == n and all(a + b == c for (a, b), (c, _) in zip(own, own[1:]))
    windows = {}
    for p in placed:
        windows.setdefault((p["lane"], p["part"] if "part" in p else 0, p["window"]), []).append((p["window_start"], p["length"]))
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= CAP


def test_long_context_leaves_out_short_and_restricted(rows):
    kept = {r["doc_id"] for r in packing.long_context(rows, 128).collect()}
    assert kept == {r["doc_id"] for r in rows.collect() if r["min_context"] <= 128 and r["size"] >= 57}


def test_position_ids_restart_and_masks_count(spark):
    seg = spark.createDataFrame([("s", 0, 0, 0, 3), ("s", 0, 0, 0, 3), ("s", 1, 3, 7, 9)], "sample_id string, seg_no int, window_start int, token_start int, token_end int")
    got = sorted((r["index"], r["segment"], r["position"]) for r in packing.position_ids(seg).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 0), (4, 1, 1)]
    assert packing.segment_problems(seg).first().asDict() == {"sample_id": "s", "segments": 2, "misnumbered": 0, "empty": 0, "misplaced": 0}
    windows = spark.createDataFrame([("a", 0, 1, 0, 5, 0), ("a", 0, 2, 0, 2, 5)], 'lane string, window long, doc_id long, offset long, length long, window_start long')
    spans = spark.createDataFrame([(1, True, 1, 4), (1, True, 4, 5), (2, True, 0, 2), (2, False, 0, 2)], "doc_id long, graded boolean, tok_start long, tok_end long")
    m = packing.masks(windows, spans, 8).first()
    # document 1: places 1 to 4; document 2: place 1, as place 0 begins a segment
    assert (m["loss"], m["context"], m["pad"], m["edges"], m["segments"]) == (5, 2, 1, 18, 2)


def test_empty_documents(spark):
    docs = spark.createDataFrame([(1, "a", None, None, None), (2, "a", "", None, None), (3, "a", " \n", None, True)], "doc_id long, lane string, text string, min_context int, reserved boolean")
    sizes = {r["doc_id"]: r["size"] for r in packing.items(docs).collect()}
    assert sizes == {2: 2, 3: 2}
    assert packing.compare(packing.items(docs).where("doc_id < 0"), CAP).count() == 6


def test_positions_of_segments_that_do_not_begin_a_window(spark, tmp_path):
    from millrace.plans import packs

    rows = [("s", 0, 0, 0, 3), ("s", 1, 3, 7, 9), ("s", 1, 3, 7, 9), ("t", 0, 0, 0, 2), ("t", 1, 2, 0, 4), ("u", 1, None, 5, 6), ("u", 2, 1, 5, 5)]
    spark.createDataFrame(rows, "sample_id string, seg_no int, window_start int, token_start int, token_end int").write.parquet(str(tmp_path / "segments.parquet"))
    got = {tuple(r[c] for c in ("segment", "positions", "sum", "last")) for r in packs.position_ids(spark, str(tmp_path)).collect()}
    assert got == {(0, 5, 4, 2), (1, 7, 7, 3)}
