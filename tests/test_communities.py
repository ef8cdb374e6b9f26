"""Louvain communities: modularity by SQL, planted groups, odd graphs."""

import random

import duckdb
import pytest

from provenant.operators import communities

SQL = """WITH e AS (SELECT a, b, w FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND w > 0),
ends AS (SELECT a AS node, w FROM e UNION ALL SELECT b, w FROM e), m AS (SELECT sum(w) AS m2 FROM ends),
k AS (SELECT node, sum(w) AS k FROM ends GROUP BY 1),
tot AS (SELECT level, community, sum(k) AS t FROM k JOIN labels USING (node) GROUP BY 1, 2),
ins AS (SELECT x.level, x.community, sum(2 * w) AS i FROM e JOIN labels x ON x.node = a JOIN labels y ON y.node = b AND y.level = x.level AND y.community = x.community GROUP BY 1, 2)
SELECT level, count(*)::BIGINT, sum(coalesce(i, 0) / m2 - (t / m2) * (t / m2)) FROM tot LEFT JOIN ins USING (level, community), m GROUP BY 1 ORDER BY 1"""


def by_sql(edges, labels):
    con = duckdb.connect()
    con.execute("CREATE TABLE edges (a BIGINT, b BIGINT, w BIGINT)")
    con.executemany("INSERT INTO edges VALUES (?, ?, ?)", edges)
    con.execute("CREATE TABLE labels (level INT, node BIGINT, community BIGINT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", [tuple(r) for r in labels])
    return con.execute(SQL).fetchall()


def planted(seed, groups, size, inside, outside):
    rng = random.Random(seed)
    n = groups * size
    return [(i, j, rng.randint(1, 3)) for i in range(n) for j in range(i) if rng.random() < (inside if i % groups == j % groups else outside)]


def test_planted_groups_are_found_and_modularity_never_falls(spark):
    edges = planted(1, 4, 12, 0.7, 0.03) + [(0, 0, 2), (None, 1, 1), (3, 4, 0), (5, 9, None)]
    frame = spark.createDataFrame(edges, "a long, b long, w long")
    labels, quality = communities.louvain(frame)
    rows = labels.collect()
    want = by_sql(edges, rows)
    assert [q for _, _, q in want] == pytest.approx(quality, abs=1e-12) and quality == sorted(quality)
    got = communities.modularity(frame, labels).orderBy("level").collect()
    assert [tuple(r)[:2] for r in got] == [w[:2] for w in want] and [r.modularity for r in got] == pytest.approx(quality, abs=1e-12)
    last = {r.node: r.community for r in rows if r.level == len(quality) - 1}
    assert len(last) == 48 and len(set(last.values())) == 4
    for g in range(4):
        assert len({c for v, c in last.items() if v % 4 == g}) == 1


def test_labels_do_not_depend_on_partitions(spark):
    edges = planted(2, 3, 8, 0.6, 0.1)
    frame = spark.createDataFrame(edges, "a long, b long, w long")
    first, second = (communities.louvain(frame.repartition(p), levels=1, rounds=5) for p in (1, 5))
    assert first[1] == second[1] and sorted(first[0].collect()) == sorted(second[0].collect())


def test_odd_graphs(spark):
    make = lambda rows: spark.createDataFrame(rows, "a string, b string, w long")
    labels, quality = communities.louvain(make([]))
    assert labels.count() == 0 and quality == [0.0]
    labels, quality = communities.louvain(make([("x", "y", 5), ("y", "x", 1), ("z", "z", 3)]))
    got = {r.node: r.community for r in labels.filter("level = 0").collect()}
    assert got["x"] == got["y"] == "x" and got["z"] == "z" and quality[-1] == pytest.approx(12 / 18 + 6 / 18 - (12 / 18) ** 2 - (6 / 18) ** 2)
    star = [("hub", f"leaf{i}", 1) for i in range(40)]
    labels, quality = communities.louvain(make(star))
    assert len({r.community for r in labels.filter(f"level = {len(quality) - 1}").collect()}) == 1
