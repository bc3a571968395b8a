"""A packing round moves rows in proportion to its pieces and gaps, however many slots the gaps have."""

import numpy as np

from marlstone.llm import packing


def test_stack_as_one_by_one():
    rng = np.random.default_rng(7)
    for n in (1, 2, 30, 400):
        is_piece = rng.random(n) < rng.choice([0.2, 0.5, 0.8])
        free, took, lost = [], {}, []
        for k, piece in enumerate(is_piece):
            if not piece:
                free.append(k)
            elif free:
                took[k] = free.pop()
            else:
                lost.append(k)
        got = packing.stacked(is_piece)
        assert (dict(zip(*map(list, got[:2]), strict=True)), list(got[2]), list(got[3])) == (took, lost, free)


def test_slots_are_no_more_than_pieces_need(spark):
    gaps = spark.createDataFrame([(k, 1000 if k % 2 else 900) for k in range(40)], "seq bigint, gap bigint")
    pieces = spark.createDataFrame([(100 + k, 1) for k in range(50)], "key bigint, length bigint")
    most, each = packing.offered({900: 20, 1000: 20}, 1, 50)
    assert (most, each) == (900, 3)
    met, rest = packing.match(gaps, pieces, 0, 1, 1, most, each)
    rows = met.collect()
    assert sum(r["kind"] == packing.TOOK for r in rows) == 50 and len(rows) == 60 and rest.count() == 20
    assert packing.offered({3: 2, 8: 5, 20: 1}, 8, 100) == (20, 20) and packing.offered({}, 8, 5) == (0, 0)
    left = {r["seq"]: r["gap"] for r in packing.gaps_after(met.unionByName(rest)).collect()}
    assert sum(left.values()) == 20 * 900 + 20 * 1000 - 50 and len(left) == 40


def test_a_round_of_a_whole_packing_stays_small(spark, monkeypatch):
    seen = []
    own = packing.match

    def match(gaps, pieces, *how):
        met, rest = own(gaps, pieces, *how)
        seen.append((met.count(), gaps.count(), pieces.count()))
        return met, rest

    monkeypatch.setattr(packing, "match", match)
    pieces = spark.createDataFrame([(k, 600 if k < 30 else 2) for k in range(60)], "__key bigint, length bigint")
    placed = packing.place(pieces, 1024).collect()
    assert len({r["sequence_id"] for r in placed}) == 30 and seen
    assert all(rows <= gaps + 3 * pieces for rows, gaps, pieces in seen)
