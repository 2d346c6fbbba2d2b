"""The whole-table graph queries against a breadth-first search: more than 40 roots, more than 6 steps, a cycle and a dangling end."""

from __future__ import annotations

from collections import defaultdict

import pytest
from conftest import rows

from curralign import queries

IDS = [f"n{i:03}" for i in range(60)]
#: (from a standard, to its prerequisite, confidence)
EDGES = [(IDS[i], IDS[i + 1], 0.9) for i in range(59)] + [(IDS[59], IDS[50], 0.9), (IDS[3], "gone", 0.9), (IDS[10], IDS[55], 0.5), ("gone", IDS[0], 0.9)]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("graph"))
    spark.createDataFrame([(x, "3") for x in IDS], "id string, grade string").write.parquet(f"{at}/standards.parquet")
    e = [(i, a, b, "prerequisite", "x", "m", "", s, 0) for i, (a, b, s) in enumerate(EDGES)]
    spark.createDataFrame(e, "id long, source_id string, target_id string, relationship string, system string, method string, notes string, confidence_score double, flagged_for_review int").write.parquet(f"{at}/standard_relationships.parquet")
    return at


def walk(floor: float, back: bool = False, roots=None) -> dict[tuple[str, str], int]:
    nxt = defaultdict(set)
    for a, b, s in EDGES:
        if s >= floor:
            nxt[b if back else a].add(a if back else b)
    out = {}
    for r in roots or [x for x in IDS if nxt[x]]:
        now = {r}
        for d in range(21):
            now = {x for x in now if (r, x) not in out}
            out |= {(r, x): d for x in now}
            now = {y for x in now for y in nxt[x]}
    return out


def test_closures_have_every_root_and_twenty_steps(spark, root):
    q = queries.queries()
    for name, back in (("gr_closure", False), ("gr_forward", True)):
        want = walk(0.9, back)
        assert len({r for r, _ in want}) == 60 and max(want.values()) == 20
        assert {(r["root"], r["node"]): r["depth"] for r in q[name](spark, root).collect()} == want
        assert q[name](spark, root).count() == len(want)


def test_paths_and_notes_have_every_root(spark, root):
    q = queries.queries()
    want = {k: d for k, d in walk(0.9).items() if k[1] != "gone"}
    path = q["gr_path"](spark, root).collect()
    assert len(path) == len(want) and {(r["root"], r["id"]): r["depth"] for r in path} == want
    assert rows(q["gr_path_notes"](spark, root), "root", "steps") == sorted((r, sum(a == r for a, _ in want)) for r in IDS)
    soft = {k for k in walk(0.5) if k[1] != "gone"}
    assert set(rows(q["tool_path"](spark, root), "root", "id")) == soft


def test_prune_has_every_root(spark, root):
    want = walk(0.9)
    got = defaultdict(set)
    for r in queries.queries()["gr_prune"](spark, root).collect():
        got[r["root"]].add(r["id"])
    for r in IDS:
        start = max((d, x) for (a, x), d in want.items() if a == r)[1]
        ahead = {x for (a, x) in walk(0.9, back=True, roots=[start])} if start != "gone" else set()
        assert r in got[r] and (start == "gone" or start in got[r])
        assert got[r] <= ahead | {r}


def test_all_pairs_closure_has_no_last_round(spark):
    from curralign.operators import graph

    edges = spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}") for i in range(67)], "src string, dst string").coalesce(1)
    assert graph.all_pairs_closure(edges).count() == 67 * 68 // 2
