"""Queries without SQL over whole tables, against brute force."""

from itertools import product
from pathlib import Path

import duckdb
import pytest
from test_queries import SF_MORE

from factloom.plans import registry


@pytest.mark.skipif(not Path(SF_MORE).exists(), reason="no driver tables here")
def test_beam_scores_facts_of_all_parts(spark):
    c = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_MORE}/{t}.parquet'")
    every = registry.oracle_sql()["role_scores"]
    pools = {}
    for request, owner, role, score in c.sql(every).fetchall():
        pools.setdefault((request, role), []).append((-score, str(owner)))
    want = []
    for request in {r for r, _ in pools}:
        states = [(0, ())]
        for role in ("primary_damage", "zone_setup", "recovery_protection", "boss_counter", "reserve_utility", "reserve_utility"):
            grown = [(total + score, (*members, owner)) for total, members in states for score, owner in sorted(pools.get((request, role), []))[:5] if owner not in members]
            states = sorted(grown)[:10]
        want += [(request, "burst", ",".join(members), -total) for total, members in states]
    got = [tuple(r) for r in registry.queries()["beam_lineups"](spark, SF_MORE).collect()]
    assert sorted(got) == sorted(want)


def test_allocation_serves_all_lines_of_an_order(spark, tmp_path):
    orders = {1: [1, 2, 3, 4, 5, 6, 7], 2: [1, 1, 1, 1], 3: [5], 4: [1, 1, 2, 3], 5: [2, 9, 4, 4, 4]}
    lines = [(o, k + 1, p) for o, parts in orders.items() for k, p in enumerate(parts)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = []
    for o, parts in orders.items():
        fits = [v for v in product((1, 2, 3), repeat=len(parts)) if len({(p + x) % 7 for p, x in zip(parts, v, strict=True)}) == len(parts)]
        want.append((o, ",".join(map(str, min(fits))) if fits else None, False))
    got = [tuple(r) for r in registry.queries()["allocate_items"](spark, str(tmp_path)).collect()]
    assert sorted((o, x or None, cut) for o, x, cut in got) == sorted(want)
