"""Members of what an owner inherits: only as far as the answer lies."""

from __future__ import annotations

from skein.operators import resolve

OWNERS, PARENTS, MEMBERS = "ref int, owner string, name string", "child string, parent string", "owner string, name string, target string"


def test_a_long_chain_is_not_walked_for_what_is_near_or_nowhere(spark, monkeypatch):
    rounds = []
    kept = resolve.written
    monkeypatch.setattr(resolve, "written", lambda df: rounds.append(1) or kept(df))
    owners = spark.createDataFrame([(k, f"c{k // 2}", "near" if k % 2 else "nowhere") for k in range(80)], OWNERS)
    parents = spark.createDataFrame([(f"c{k}", f"c{k - 1}") for k in range(1, 40)], PARENTS)
    members = spark.createDataFrame([(f"c{k}", "near", f"t{k}") for k in range(0, 40, 2)], MEMBERS)
    got = {r.ref: (r.candidates, r.target_id) for r in resolve.owner_members(owners, parents, members, True).collect()}
    assert got == {k: (1, f"t{k // 4 * 2}") if k % 2 else (0, None) for k in range(80)}
    assert len(rounds) <= 4  # the chain has 39 steps


def test_far_members_cycles_and_several_parents(spark):
    chain = [(f"c{k}", f"c{k - 1}") for k in range(1, 22)]
    parents = spark.createDataFrame([*chain, ("a", "b"), ("b", "a"), ("d", "l"), ("d", "r"), ("l", "top"), ("r", "top"), ("e", None)], PARENTS)
    members = spark.createDataFrame([("c0", "m", "far"), ("l", "m", "tl"), ("r", "m", "tr"), ("top", "m", "tt"), ("top", "n", "tn"), ("top", "n", "tn"), ("c5", "z", None)], MEMBERS)
    owners = spark.createDataFrame([(1, "c21", "m"), (2, "a", "m"), (3, "d", "m"), (4, "d", "n"), (5, "l", "m"), (6, "e", "m"), (7, None, "m"), (8, "c9", "z")], OWNERS)
    got = {r.ref: (r.candidates, r.target_id) for r in resolve.owner_members(owners, parents, members, True).collect()}
    assert got == {1: (1, "far"), 2: (0, None), 3: (2, None), 4: (1, "tn"), 5: (1, "tl"), 6: (0, None), 7: (0, None), 8: (0, None)}
    got = {r.ref: (r.candidates, r.target_id) for r in resolve.owner_members(owners, parents, members, False).collect()}
    assert got == {1: (1, "far"), 2: (0, None), 3: (3, None), 4: (1, "tn"), 5: (2, None), 6: (0, None), 7: (0, None), 8: (0, None)}
