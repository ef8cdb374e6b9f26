"""Independent SQL for the named queries, runnable by DuckDB on the same tables."""

from __future__ import annotations

from .proxies import CUTOFF

_VIEWS = {
    "xfer": """SELECT o_custkey AS to_address, o_orderkey % greatest(o_custkey, 1) AS from_address,
        CAST(o_totalprice AS DECIMAL(18,2)) AS value, o_orderdate AS ts,
        date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS block, o_orderkey AS tx FROM orders""",
    "first_edge": """SELECT to_address AS activated_address, from_address AS gas_provider, value AS amount, ts, block, tx FROM (
        SELECT *, row_number() OVER (PARTITION BY to_address ORDER BY ts, tx) AS rn,
        count(*) OVER (PARTITION BY to_address, ts, block) AS cnt FROM xfer WHERE value > 0) WHERE rn = 1 AND cnt = 1""",
    "labeled": "SELECT c_custkey AS address FROM customer WHERE c_mktsegment = 'BUILDING'",
    "cex": "SELECT c_custkey AS address FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "dex": "SELECT c_custkey AS address FROM customer WHERE c_mktsegment = 'FURNITURE'",
    "interactors": "SELECT c_custkey AS address FROM customer WHERE c_acctbal >= 0",
    "sybil_set": """SELECT c_custkey AS address FROM customer LEFT JOIN (SELECT o_custkey, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
        ON o_custkey = c_custkey WHERE (coalesce(quantity, 0) > 1150) <> (left(md5(c_custkey::VARCHAR), 1) = 'f')""",
    "label_dim": """SELECT address, 'cex' AS label_type FROM cex UNION ALL SELECT address, 'dex' FROM dex
        UNION ALL SELECT address, 'cex' FROM cex UNION ALL SELECT address, 'other' FROM labeled""",
    "msg": """SELECT o_custkey AS sender, l_returnflag AS source_chain, o_orderpriority AS destination_chain, p_brand AS project,
        l_suppkey AS source_contract, l_partkey AS destination_contract,
        nullif(CAST(l_extendedprice AS DECIMAL(18,2)), 0) AS swap, nullif(CAST(l_discount AS DECIMAL(18,2)), 0) AS dropped,
        l_orderkey AS tx, CAST(epoch(l_shipdate) AS BIGINT) AS sec
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "txs": """SELECT o_custkey AS from_address, l_suppkey AS to_address, CAST(l_extendedprice AS DECIMAL(18,2)) AS value,
        CAST(l_tax AS DECIMAL(18,2)) AS fee, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS block, l_shipdate AS ts
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "eth": "SELECT sender AS addr, count(DISTINCT tx) AS n_eth_interactions FROM msg WHERE source_chain = 'A' GROUP BY 1",
    "l0": """SELECT addr, n_eth_interactions, count(DISTINCT source_chain) AS n_l0_source_chains,
        count(DISTINCT destination_chain) AS n_l0_dest_chains, count(DISTINCT project) AS n_l0_projects,
        count(DISTINCT source_contract) AS n_l0_source_contracts, count(DISTINCT destination_contract) AS n_l0_dest_contracts,
        count(DISTINCT tx) AS n_l0_txs,
        CAST(max(coalesce(swap, 0)) AS DOUBLE) AS l0_max_stargate_swap,
        CAST(sum(coalesce(swap, 0)) AS DOUBLE) / count(*) AS l0_avg_stargate_swap,
        CAST(min(coalesce(swap, 0)) AS DOUBLE) AS l0_min_stargate_swap,
        CAST(max(coalesce(dropped, 0)) AS DOUBLE) AS l0_max_native_drop_usd,
        CAST(sum(coalesce(dropped, 0)) AS DOUBLE) / count(*) AS l0_avg_native_drop_usd,
        min(sec) AS earliest_l0_tx_time, max(sec) AS latest_l0_tx_time, max(sec) - min(sec) AS l0_tx_time_span,
        CAST(count(DISTINCT destination_chain) AS DOUBLE) / count(DISTINCT source_chain) AS n_l0_dest_chain_per_source_chain,
        CAST(count(DISTINCT project) AS DOUBLE) / count(DISTINCT source_chain) AS n_l0_project_per_source_chain
        FROM msg JOIN eth ON sender = addr GROUP BY addr, n_eth_interactions""",
    "l0_home": """SELECT addr, count(DISTINCT source_chain) AS n_l0_to_eth_source_chains, count(DISTINCT project) AS n_l0_to_eth_projects,
        count(DISTINCT source_contract) AS n_l0_to_eth_source_contracts, count(DISTINCT destination_contract) AS n_l0_to_eth_dest_contracts,
        count(DISTINCT tx) AS n_l0_to_eth_txs,
        CAST(max(coalesce(swap, 0)) AS DOUBLE) AS l0_to_eth_max_stargate_swap,
        CAST(sum(coalesce(swap, 0)) AS DOUBLE) / count(*) AS l0_to_eth_avg_stargate_swap,
        CAST(min(coalesce(swap, 0)) AS DOUBLE) AS l0_to_eth_min_stargate_swap,
        CAST(max(coalesce(dropped, 0)) AS DOUBLE) AS l0_to_eth_max_native_drop_usd,
        CAST(sum(coalesce(dropped, 0)) AS DOUBLE) / count(*) AS l0_to_eth_avg_native_drop_usd,
        min(sec) AS earliest_l0_to_eth_tx_time, max(sec) AS latest_l0_to_eth_tx_time, max(sec) - min(sec) AS l0_to_eth_tx_time_span,
        CAST(count(DISTINCT project) AS DOUBLE) / count(DISTINCT source_chain) AS n_l0_to_eth_project_per_source_chain
        FROM msg JOIN eth ON sender = addr WHERE destination_chain = '1-URGENT' GROUP BY addr""",
    "tx_out": f"""SELECT from_address AS addr, count(*) AS num_transactions, min(block) AS earliest_tx_block_out,
        max(block) AS latest_tx_block_out, max(block) - min(block) AS tx_block_span,
        CAST(max(value) AS DOUBLE) AS max_tx_value_out, CAST(min(value) AS DOUBLE) AS min_tx_value_out,
        CAST(sum(value) AS DOUBLE) AS total_tx_value_out, CAST(sum(value) AS DOUBLE) / count(*) AS avg_tx_value_out,
        CAST(max(fee) AS DOUBLE) AS max_tx_fee_out, CAST(min(fee) AS DOUBLE) AS min_tx_fee_out,
        count(DISTINCT to_address) AS out_degree
        FROM txs WHERE ts <= TIMESTAMP '{CUTOFF}' AND from_address IN (SELECT addr FROM eth) GROUP BY 1""",
    "tx_in": f"""SELECT to_address AS addr, count(*) AS num_transactions_in, min(block) AS earliest_tx_block_in,
        max(block) AS latest_tx_block_in, CAST(max(value) AS DOUBLE) AS max_tx_value_in, CAST(min(value) AS DOUBLE) AS min_tx_value_in,
        CAST(sum(value) AS DOUBLE) AS total_tx_value_in, CAST(sum(value) AS DOUBLE) / count(*) AS avg_tx_value_in,
        count(DISTINCT from_address) AS in_degree
        FROM txs WHERE ts < TIMESTAMP '{CUTOFF}' AND to_address IN (SELECT addr FROM eth) GROUP BY 1""",
    "behaviour": """SELECT *, latest_tx_block_out - earliest_tx_block_out AS time_span_out,
        CASE WHEN coalesce(latest_tx_block_out - earliest_tx_block_out, 0) = 0 THEN 0.0
          ELSE CAST(coalesce(out_degree, 0) AS DOUBLE) / (latest_tx_block_out - earliest_tx_block_out) END AS out_degree_per_block_out,
        CASE WHEN coalesce(latest_tx_block_out - earliest_tx_block_out, 0) = 0 THEN 0.0
          ELSE coalesce(total_tx_value_out, 0.0) / (latest_tx_block_out - earliest_tx_block_out) END AS tx_value_per_block_out,
        latest_tx_block_in - earliest_tx_block_in AS time_span_in,
        CASE WHEN latest_tx_block_in - earliest_tx_block_in = 0 THEN 0.0
          ELSE CAST(in_degree AS DOUBLE) / (latest_tx_block_in - earliest_tx_block_in) END AS indegree_per_block_in,
        CASE WHEN latest_tx_block_in - earliest_tx_block_in = 0 THEN 0.0
          ELSE total_tx_value_in / (latest_tx_block_in - earliest_tx_block_in) END AS tx_value_per_block_in,
        in_degree * out_degree AS possible_triangles
        FROM (SELECT l0.*, h.* EXCLUDE (addr), o.* EXCLUDE (addr),
          coalesce(num_transactions_in, 0) AS num_transactions_in, coalesce(earliest_tx_block_in, 0) AS earliest_tx_block_in,
          coalesce(latest_tx_block_in, 0) AS latest_tx_block_in, coalesce(max_tx_value_in, 0.0) AS max_tx_value_in,
          coalesce(min_tx_value_in, 0.0) AS min_tx_value_in, coalesce(total_tx_value_in, 0.0) AS total_tx_value_in,
          coalesce(avg_tx_value_in, 0.0) AS avg_tx_value_in, coalesce(in_degree, 0) AS in_degree
          FROM l0 LEFT JOIN l0_home h USING (addr) LEFT JOIN tx_out o USING (addr) LEFT JOIN tx_in i USING (addr))""",
    "exch": f"""SELECT c_custkey AS to_address, coalesce(max(CASE WHEN label_type = 'cex' THEN n END), 0) AS cex_in_count,
        coalesce(max(CASE WHEN label_type = 'dex' THEN n END), 0) AS dex_in_count
        FROM customer LEFT JOIN (SELECT to_address, label_type, count(DISTINCT from_address) AS n FROM xfer
          JOIN label_dim ON from_address = address WHERE ts <= TIMESTAMP '{CUTOFF}' GROUP BY 1, 2) ON c_custkey = to_address GROUP BY 1""",
    "irows": "SELECT gas_provider, activated_address, amount FROM first_edge WHERE activated_address IN (SELECT address FROM interactors)",
    "tedge": """SELECT activated_address, gas_provider FROM first_edge WHERE activated_address NOT IN (SELECT address FROM labeled)
        AND gas_provider NOT IN (SELECT address FROM labeled) AND activated_address <> gas_provider""",
    "placed": """SELECT DISTINCT gas_provider AS node, gas_provider AS root, CAST(0 AS BIGINT) AS depth FROM tedge
        WHERE gas_provider NOT IN (SELECT activated_address FROM tedge)
        UNION ALL SELECT t.activated_address, p.root, p.depth + 1 FROM tedge t JOIN placed p ON t.gas_provider = p.node""",
    "nodes": """SELECT p.*, coalesce(k.n, 0) AS n_children, coalesce(g.gas, 0.0) AS gas, k.n IS NULL AS leaf FROM placed p
        LEFT JOIN (SELECT gas_provider, count(*) AS n FROM tedge GROUP BY 1) k ON k.gas_provider = p.node
        LEFT JOIN (SELECT activated_address, CAST(sum(amount) AS DOUBLE) AS gas FROM first_edge GROUP BY 1) g
          ON g.activated_address = p.node""",
    "given": "SELECT root, node, gas AS a, 'all' AS kind FROM nodes WHERE depth > 0 AND gas > 0 UNION ALL SELECT root, node, gas, 'leaf' FROM nodes WHERE leaf",
    "stats": """SELECT root, kind,
        -sum(CASE WHEN a > 0 THEN a / s * log2(a / s) END) AS entropy,
        CASE WHEN avg((a - m) * (a - m)) > 0 THEN avg((a - m) * (a - m) * (a - m)) / pow(avg((a - m) * (a - m)), 1.5) ELSE 0.0 END AS skew
        FROM (SELECT *, sum(a) OVER w AS s, avg(a) OVER w AS m FROM given WINDOW w AS (PARTITION BY root, kind)) GROUP BY 1, 2""",
    "tm": """SELECT n.root, count(*) AS tree_size, coalesce(sum(CASE WHEN depth > 0 AND gas > 0 THEN gas END), 0.0) AS total_gas,
        max(depth) AS max_depth, CAST(sum(n_children) AS DOUBLE) / count(*) AS branching_factor,
        max(depth) - min(CASE WHEN leaf THEN depth END) AS balance_factor,
        CASE WHEN coalesce(sum(CASE WHEN depth > 0 AND gas > 0 THEN gas END), 0.0) = 0 THEN 0.0
          ELSE sum(CASE WHEN leaf THEN gas END) / sum(CASE WHEN depth > 0 AND gas > 0 THEN gas END) END AS leaf_provision_proportion,
        avg(depth) AS avg_depth, coalesce(var_samp(depth), 0.0) AS depth_variance,
        CASE WHEN count(*) FILTER (NOT leaf) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (leaf) AS DOUBLE) / count(*) FILTER (NOT leaf) END AS leaf_to_internal_ratio,
        avg(CASE WHEN leaf THEN gas END) AS avg_leaf_gas, CAST(count(*) AS DOUBLE) / (max(depth) + 1) AS breadth_factor,
        CASE WHEN max(depth) = 0 THEN 0.0 ELSE CAST(count(*) AS DOUBLE) / (max(depth) + 1) / max(depth) END AS breadth_to_depth_ratio,
        CAST(max(depth) AS DOUBLE) / count(*) AS longest_chain_ratio,
        CAST(count(*) FILTER (n_children > 1) AS DOUBLE) / count(*) AS star_like_ratio,
        CASE WHEN sum(depth) = 0 THEN 0.0 ELSE sum(gas * depth) / sum(depth) END AS depth_weighted_avg_gas,
        CAST(count(*) FILTER (gas > 0) AS DOUBLE) / count(*) AS sparsity, 0.0 AS gini_coefficient,
        CASE WHEN count(*) >= 3 AND count(DISTINCT depth) = count(*) THEN count(*) ELSE 0 END AS pure_chain_length
        FROM nodes n GROUP BY 1""",
    "up": """SELECT node AS anc, 0::BIGINT AS d, node, root, depth FROM placed
        UNION ALL SELECT t.gas_provider, u.d + 1, u.node, u.root, u.depth FROM up u JOIN tedge t ON t.activated_address = u.anc""",
    "sizes": "SELECT anc AS node, root, count(*) AS size FROM up GROUP BY 1, 2",
    "apart": """SELECT x.root, x.node, y.node AS other, min(x.d + y.d) AS far FROM up x JOIN up y ON x.anc = y.anc WHERE x.node <> y.node GROUP BY 1, 2, 3""",
    "parts": """SELECT t.gas_provider AS node, size AS part FROM sizes JOIN tedge t ON t.activated_address = node
        UNION ALL SELECT s.node, r.size - s.size FROM sizes s JOIN sizes r ON r.node = s.root""",
    "through": "SELECT node, (sum(part) * sum(part) - sum(part * part)) / 2.0 AS betweenness FROM parts GROUP BY 1",
    "pmap": "SELECT activated_address AS addr, gas_provider FROM first_edge",
    "walk": """SELECT c_custkey AS addr, c_custkey AS cur, CAST(0 AS BIGINT) AS len, CAST(0 AS BIGINT) AS cnt, true AS going FROM customer
        UNION ALL SELECT w.addr, f.gas_provider, w.len + (f.gas_provider IS NOT NULL AND f.gas_provider <> w.cur)::BIGINT,
          w.cnt + (w.cur IN (SELECT address FROM interactors))::BIGINT,
          f.gas_provider IS NOT NULL AND f.gas_provider <> w.cur AND f.gas_provider NOT IN (SELECT address FROM labeled)
        FROM walk w LEFT JOIN pmap f ON f.addr = w.cur WHERE w.going""",
    "walked": "SELECT addr, max(len) AS chain_length, max(cnt) AS interactors_in_chain FROM walk GROUP BY 1",
    "star": """SELECT gas_provider, count(DISTINCT activated_address) AS provider_fan_out,
        CAST(sum(amount) AS DOUBLE) AS provider_total_gas_provision_amount,
        CAST(max(amount) AS DOUBLE) AS provider_max_gas_provision_amount, CAST(min(amount) AS DOUBLE) AS provider_min_gas_provision_amount,
        CAST(sum(amount) AS DOUBLE) / count(DISTINCT activated_address) AS provider_avg_gas_provision_amount FROM {rows} GROUP BY 1""",
    "scored": "SELECT CAST(l_quantity AS BIGINT) / 50.0 AS score, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem",
    "cuts": """SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM
        (SELECT score AS threshold, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY 1) WINDOW w AS (ORDER BY threshold DESC)""",
    "pr": """SELECT threshold, tp / (tp + fp) AS "precision", tp / pos AS recall,
        CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos) END AS f1
        FROM (SELECT threshold, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(pos AS DOUBLE) AS pos FROM cuts)""",
    "splits": """SELECT addr, sybil, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + round((n - nt) * 0.3) THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT *, round(n * 0.3) AS nt FROM (SELECT addr, sybil, row_number() OVER (PARTITION BY sybil ORDER BY md5(addr || ':42'), addr) AS rn, count(*) OVER (PARTITION BY sybil) AS n
          FROM (SELECT c_custkey AS addr, CAST(c_custkey IN (SELECT address FROM sybil_set) AS INTEGER) AS sybil FROM customer)))""",
}


def _with(names: str, body: str, **extra: str) -> str:
    views = _VIEWS | extra
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({views[n]})" for n in names.split()) + " " + body


def _round(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {2 if c == 'total_gas' else digits}) + 0.0 AS {c}" for c in columns.split())


_PLACED = "xfer first_edge labeled tedge placed"
_FOREST = _PLACED + " nodes"
_BEHAVIOUR = "msg txs eth l0 l0_home tx_out tx_in behaviour"
_MONEY = "max_stargate_swap avg_stargate_swap min_stargate_swap max_native_drop_usd avg_native_drop_usd"
_L0_D = " ".join(f"l0_{c}" for c in _MONEY.split()) + " n_l0_dest_chain_per_source_chain n_l0_project_per_source_chain"
_HOME_D = " ".join(f"l0_to_eth_{c}" for c in _MONEY.split()) + " n_l0_to_eth_project_per_source_chain"
_OUT_D = "max_tx_value_out min_tx_value_out total_tx_value_out avg_tx_value_out max_tx_fee_out min_tx_fee_out"
_IN_D = "max_tx_value_in min_tx_value_in total_tx_value_in avg_tx_value_in"
_RATE_D = "out_degree_per_block_out tx_value_per_block_out indegree_per_block_in tx_value_per_block_in"
_STAR_D = " ".join(f"provider_{c}_gas_provision_amount" for c in ("total", "avg", "max", "min"))


def _rounded_star(columns: str, digits: int = 6) -> str:
    """All columns, the named ones rounded."""
    return "* REPLACE (" + _round(columns, digits) + ")"


def _master() -> str:
    from ..operators.master import FEATURES

    spread = [c for c in FEATURES if "entropy" in c or "skewness" in c]
    flags = {"provider_is_labeled", "provider_is_interactor", "provider_is_null", "is_provider"}
    doubles = set((_L0_D + " " + _HOME_D + " " + _OUT_D + " " + _IN_D + " " + _RATE_D + " " + _STAR_D).split()) | set(
        """total_gas branching_factor leaf_provision_proportion avg_depth leaf_to_internal_ratio breadth_factor
        breadth_to_depth_ratio gini_coefficient gini_true sparsity longest_chain_ratio star_like_ratio""".split()
    )
    doubles |= set(spread)
    digits = {"total_gas": 2} | dict.fromkeys(spread, 5)
    columns = ", ".join(
        c if c in flags else f"round(coalesce({c}, 0.0), {digits.get(c, 6)}) + 0.0 AS {c}" if c in doubles else f"coalesce({c}, 0) AS {c}"
        for c in [*FEATURES, "gini_true"]
    )
    # both Gini columns from the amounts: the inherited formula, which is 0 but for rounding errors, and the real coefficient
    unequal = """SELECT root, (count(*) - 1.0) / count(*) * (1 - sum(gas / s)) AS gini_coefficient,
        (2 * sum(i * gas) - (count(*) + 1) * sum(gas)) / (count(*) * sum(gas)) AS gini_true
        FROM (SELECT root, gas, sum(gas) OVER (PARTITION BY root) AS s, row_number() OVER (PARTITION BY root ORDER BY gas, node) AS i
          FROM nodes WHERE depth > 0 AND gas > 0) GROUP BY 1"""
    # equal amounts have no skewness, though their mean may be off by a rounding error
    stats = _VIEWS["stats"].replace("WHEN avg((a - m) * (a - m)) > 0", "WHEN max(a) > min(a)")
    wide = f"""SELECT b.*, c.* EXCLUDE (to_address), s.* EXCLUDE (gas_provider), t.* EXCLUDE (root, gini_coefficient),
        u.* EXCLUDE (root), ga.entropy AS gas_distribution_entropy, ga.skew AS gas_distribution_skewness,
        gl.entropy AS leaf_gas_distribution_entropy, gl.skew AS leaf_gas_distribution_skewness, n.depth, f.block AS gas_provision_block_number,
        CASE WHEN f.activated_address IS NULL OR f.activated_address NOT IN (SELECT address FROM interactors) THEN NULL
          ELSE CAST(s.provider_fan_out > 1 AND f.gas_provider NOT IN (SELECT address FROM labeled) AS INTEGER) END AS provider_is_star_like_attack,
        coalesce(f.gas_provider IN (SELECT address FROM labeled), false) AS provider_is_labeled,
        coalesce(f.gas_provider IN (SELECT address FROM cex), false) AS provider_is_cex,
        coalesce(f.gas_provider IN (SELECT addr FROM behaviour), false) AS provider_is_interactor,
        f.gas_provider IS NULL AS provider_is_null, b.addr IN (SELECT gas_provider FROM first_edge) AS is_provider,
        b.addr IN (SELECT address FROM sybil_set) AS sybil, w.chain_length, w.interactors_in_chain
        FROM behaviour b JOIN exch c ON c.to_address = b.addr LEFT JOIN first_edge f ON f.activated_address = b.addr
        LEFT JOIN star s ON s.gas_provider = f.gas_provider AND f.activated_address IN (SELECT address FROM interactors)
        LEFT JOIN nodes n ON n.node = b.addr AND n.depth >= 1 LEFT JOIN tm t ON t.root = n.root LEFT JOIN walked w ON w.addr = b.addr
        LEFT JOIN unequal u ON u.root = n.root LEFT JOIN stats ga ON ga.root = n.root AND ga.kind = 'all'
        LEFT JOIN stats gl ON gl.root = n.root AND gl.kind = 'leaf'"""
    names = _BEHAVIOUR + f" {_FOREST} cex dex interactors sybil_set label_dim exch irows star tm given stats unequal pmap own walk walked wide"
    # the walk's interactors are the frame's own addresses
    own = "SELECT addr AS address FROM behaviour WHERE addr IN (SELECT to_address FROM exch)"
    walk = _VIEWS["walk"].replace("SELECT address FROM interactors", "SELECT address FROM own")
    star = _VIEWS["star"].format(rows="irows")
    return _with(
        names, f"SELECT addr, sybil, provider_is_cex, {columns} FROM wide", star=star, stats=stats, unequal=unequal, wide=wide, own=own, walk=walk
    )


def _report() -> str:
    cells = """SELECT count(*) FILTER (label = 1 AND score > 0.5) AS tp, count(*) FILTER (label = 0 AND score > 0.5) AS fp,
        count(*) FILTER (label = 1 AND score <= 0.5) AS fn, count(*) FILTER (label = 0 AND score <= 0.5) AS tn FROM scored"""
    rates = """SELECT CAST(tn AS DOUBLE) / (tn + fn) AS p0, CAST(tn AS DOUBLE) / (tn + fp) AS r0, CAST(tp AS DOUBLE) / (tp + fp) AS p1,
        CAST(tp AS DOUBLE) / (tp + fn) AS r1, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS acc,
        CAST(tn + fp AS DOUBLE) AS n0, CAST(tp + fn AS DOUBLE) AS n1 FROM cells"""
    f = "SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM rates"
    rows = [
        ("0", "p0", "r0", "f0", "n0"),
        ("1", "p1", "r1", "f1", "n1"),
        ("accuracy", "acc", "acc", "acc", "n0 + n1"),
        ("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "n0 + n1"),
        ("weighted avg", *[f"({a}0 * n0 + {a}1 * n1) / (n0 + n1)" for a in "prf"], "n0 + n1"),
    ]
    body = " UNION ALL ".join(
        f"SELECT '{c}' AS class, round({p}, 6) AS \"precision\", round({r}, 6) AS recall, round({x}, 6) AS f1, {n} AS support FROM f"
        for c, p, r, x, n in rows
    )
    return _with("scored cells rates f", body, cells=cells, rates=rates, f=f)


def oracle_sql() -> dict[str, str]:
    tm = _FOREST + " tm"
    stats = _FOREST + " given stats"
    pick = lambda column, kind: f"coalesce(round(max(CASE WHEN kind = '{kind}' THEN {column} END), 5), 0.0) + 0.0"
    per_kind = lambda column, name: (
        f"SELECT r.root, {pick(column, 'all')} AS gas_distribution_{name}, {pick(column, 'leaf')} AS leaf_gas_distribution_{name} "
        "FROM (SELECT DISTINCT root FROM placed) r LEFT JOIN stats s ON s.root = r.root GROUP BY 1"
    )
    edge = "activated_address, gas_provider, CAST(amount AS DOUBLE) AS amount, CAST(epoch(ts) AS BIGINT) AS ts, block, tx"
    xrows = "SELECT from_address AS gas_provider, to_address AS activated_address, value AS amount FROM xfer"
    return {
        "scan_filter_zero": "SELECT nullif(c_custkey, 7) AS addr, c_name FROM customer WHERE c_custkey <> 0",
        "dropna_all": """SELECT CASE WHEN c_nationkey > 3 THEN c_nationkey END AS nation, CASE WHEN c_acctbal > 1000 THEN c_acctbal END AS balance,
            c_custkey AS addr FROM customer WHERE c_nationkey > 3 OR c_acctbal > 1000""",
        "dedup_keep_first": """SELECT o_custkey AS addr, o_orderkey AS load_order, o_orderstatus FROM orders
            WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey)""",
        "dedup_keep_first_pair": _with("xfer", "SELECT to_address, from_address, min(tx) AS tx FROM xfer GROUP BY 1, 2"),
        "dup_pairs": _with(
            "xfer",
            "SELECT to_address, from_address, tx FROM (SELECT *, count(*) OVER (PARTITION BY to_address, from_address) AS n FROM xfer) WHERE n > 1",
        ),
        "multi_provider": _with(
            "xfer", "SELECT to_address, count(DISTINCT from_address) AS n_providers FROM xfer GROUP BY 1 HAVING count(DISTINCT from_address) > 1"
        ),
        "unit_scaling": """SELECT o_orderkey AS addr, round(CASE WHEN o_orderkey % 10 <> 3 THEN
            CAST(o_orderkey || '000000000000' AS DOUBLE) / 1e9 / 1e9 END, 9) AS amount FROM orders WHERE o_orderkey <> 0""",
        "fill_missing": """SELECT c_custkey AS addr, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0 END AS balance,
            c_nationkey > 3 AND c_nationkey > 10 AS flag FROM customer""",
        "provider_map_last_wins": _with("xfer", "SELECT to_address, arg_max(from_address, tx) AS from_address FROM xfer GROUP BY 1"),
        "label_union": _with(
            "labeled cex dex",
            """SELECT CAST(address AS VARCHAR) AS address FROM labeled UNION SELECT CAST(address AS VARCHAR) FROM cex
            UNION SELECT CAST(address AS VARCHAR) FROM dex UNION SELECT 'ab1' UNION SELECT 'cd2'""",
        ),
        "membership_flags": _with(
            "labeled cex interactors",
            """SELECT nullif(c_custkey, 5) AS addr, c_custkey <> 5 AND c_custkey IN (SELECT address FROM labeled) AS is_labeled,
            c_custkey <> 5 AND c_custkey IN (SELECT address FROM cex) AS is_cex,
            c_custkey <> 5 AND c_custkey IN (SELECT address FROM interactors) AS is_interactor FROM customer""",
        ),
        "provider_flags": _with(
            "xfer first_edge labeled cex interactors",
            """SELECT c_custkey AS addr, gas_provider, coalesce(gas_provider IN (SELECT address FROM labeled), false) AS provider_is_labeled,
            coalesce(gas_provider IN (SELECT address FROM cex), false) AS provider_is_cex,
            coalesce(gas_provider IN (SELECT address FROM interactors), false) AS provider_is_interactor,
            gas_provider IS NULL AS provider_is_null FROM customer LEFT JOIN first_edge ON activated_address = c_custkey""",
        ),
        "is_provider": _with(
            "xfer first_edge sybil_set",
            """SELECT c_custkey AS addr, c_custkey IN (SELECT address FROM sybil_set) AS sybil,
            c_custkey IN (SELECT gas_provider FROM first_edge) AS is_provider FROM customer""",
        ),
        "eth_interactions": _with("msg eth", "SELECT * FROM eth"),
        "msg_features": _with("msg eth l0", f"SELECT {_rounded_star(_L0_D)} FROM l0"),
        "msg_to_home_features": _with("msg eth l0_home", f"SELECT {_rounded_star(_HOME_D)} FROM l0_home"),
        "tx_out_features": _with("msg txs eth tx_out", f"SELECT {_rounded_star(_OUT_D)} FROM tx_out"),
        "tx_in_features": _with("msg txs eth tx_in", f"SELECT {_rounded_star(_IN_D)} FROM tx_in"),
        "behaviour_master": _with(
            _BEHAVIOUR, f"SELECT {_rounded_star(' '.join((_L0_D, _HOME_D, _OUT_D, _IN_D, _RATE_D)))} FROM behaviour"
        ),
        "rank_range": _with(
            "xfer",
            """SELECT addr, tx, rank FROM (SELECT nullif(to_address, 3) AS addr, tx,
            rank() OVER (ORDER BY nullif(to_address, 3) ASC NULLS LAST) AS rank FROM xfer) WHERE rank BETWEEN 101 AND 1100""",
        ),
        "limit_offset": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 40",
        "exchange_counterparties": _with(
            "xfer labeled cex dex label_dim",
            f"""SELECT to_address, label_type, count(DISTINCT from_address) AS n FROM xfer JOIN label_dim ON from_address = address
            WHERE ts <= TIMESTAMP '{CUTOFF}' GROUP BY 1, 2""",
        ),
        "exchange_pivot": _with("xfer labeled cex dex label_dim exch", "SELECT * FROM exch"),
        "first_funding": _with("xfer first_edge", f"SELECT {edge} FROM first_edge"),
        "provision_closure": _with(
            "xfer first_edge cex interactors seeds reach",
            f"SELECT DISTINCT {edge} FROM first_edge WHERE activated_address IN (SELECT a FROM reach)",
            seeds="SELECT address AS a FROM interactors WHERE address IN (SELECT address FROM cex)",
            reach="SELECT a FROM seeds UNION SELECT gas_provider FROM first_edge JOIN reach ON activated_address = a",
        ),
        "provider_star": _with(
            "xfer first_edge interactors irows star", f"SELECT {_rounded_star(_STAR_D)} FROM star", star=_VIEWS["star"].format(rows="irows")
        ),
        "star_flag_running": _with(
            "xfer labeled xrows star",
            f"""SELECT x.gas_provider, x.activated_address, CAST(x.amount AS DOUBLE) AS amount, s.provider_fan_out, {_round(_STAR_D)},
            max(CAST(s.provider_fan_out > 1 AND x.gas_provider NOT IN (SELECT address FROM labeled) AS INTEGER))
              OVER (PARTITION BY x.activated_address ORDER BY x.gas_provider) AS provider_is_star_like_attack
            FROM xrows x JOIN star s USING (gas_provider)""",
            xrows=xrows,
            star=_VIEWS["star"].format(rows="xrows"),
        ),
        "edge_exclusion": _with("xfer first_edge labeled tedge", "SELECT * FROM tedge"),
        "roots_depth": _with("xfer first_edge labeled tedge placed", "SELECT *, false AS in_cycle FROM placed"),
        "tree_metrics_shape": _with(
            tm,
            "SELECT root, tree_size, max_depth, balance_factor, "
            + _round("branching_factor avg_depth depth_variance leaf_to_internal_ratio breadth_factor breadth_to_depth_ratio longest_chain_ratio star_like_ratio")
            + " FROM tm",
        ),
        "tree_metrics_gas": _with(
            tm,
            "SELECT root, " + _round("total_gas leaf_provision_proportion avg_leaf_gas depth_weighted_avg_gas sparsity") + ", CAST(0 AS DOUBLE) AS gini_coefficient FROM tm",
        ),
        "tree_entropy": _with(stats, per_kind("entropy", "entropy")),
        "tree_skew": _with(stats, per_kind("skew", "skewness")),
        "gini_true": _with(
            _FOREST,
            """SELECT root, round((2 * sum(i * gas) - (count(*) + 1) * sum(gas)) / (count(*) * sum(gas)), 6) + 0.0 AS gini_true FROM
            (SELECT *, row_number() OVER (PARTITION BY root ORDER BY gas, node) AS i FROM nodes WHERE depth > 0 AND gas > 0) GROUP BY 1""",
        ),
        "pure_chain": _with(tm, "SELECT root, pure_chain_length FROM tm"),
        "largest_trees": _with(tm, "SELECT root, tree_size FROM tm ORDER BY tree_size DESC, root LIMIT 20"),
        "member_features": _with(
            tm, "SELECT node AS addr, depth, tree_size, max_depth FROM nodes JOIN tm USING (root) WHERE depth >= 1"
        ),
        "subtree_totals": _with(
            f"{_PLACED} up",
            """SELECT anc AS node, u.root, min(depth) AS depth, count(*) AS subtree_size, round(coalesce(sum(amount), 0)::DOUBLE, 2) + 0.0 AS subtree_amount,
            round(coalesce(sum(amount * depth), 0)::DOUBLE, 2) + 0.0 AS subtree_depth_amount FROM up u
            LEFT JOIN (SELECT activated_address, sum(amount) AS amount FROM first_edge GROUP BY 1) g ON g.activated_address = u.node GROUP BY 1, 2""",
        ),
        "node_centrality": _with(
            f"{_PLACED} up sizes apart parts through",
            """SELECT node, root, sum(far)::BIGINT AS distance_sum, round(count(*)::DOUBLE / sum(far), 9) + 0.0 AS closeness, round(betweenness::DOUBLE, 9) + 0.0 AS betweenness
            FROM apart JOIN through USING (node) GROUP BY node, root, betweenness""",
        ),
        "tree_paths": _with(
            f"{_PLACED} up sizes apart parts through",
            """SELECT root, tree_size, round(mean_path_length, 9) + 0.0 AS mean_path_length, round(max_betweenness::DOUBLE, 9) + 0.0 AS max_betweenness,
            round(max_edge_betweenness, 9) + 0.0 AS max_edge_betweenness FROM (SELECT root, avg(far) AS mean_path_length FROM apart GROUP BY 1)
            JOIN (SELECT s.root, max(betweenness) AS max_betweenness, max(r.size) AS tree_size, max((s.size * (r.size - s.size))::DOUBLE) AS max_edge_betweenness
            FROM sizes s JOIN sizes r ON r.node = s.root JOIN through t ON t.node = s.node GROUP BY 1) USING (root)""",
        ),
        "timed_provision": _with(
            "xfer cex moves states least tight steps",
            "SELECT node AS address, day AS arrival, min(hops) AS hops FROM steps JOIN least USING (node) GROUP BY 1, 2",
            moves="SELECT DISTINCT from_address AS a, to_address AS b, block AS t FROM xfer WHERE value > 0 AND from_address <> to_address AND to_address NOT IN (SELECT address FROM cex)",
            states="SELECT address AS node, -1000000::BIGINT AS day FROM cex UNION SELECT b, t FROM states JOIN moves ON a = node AND t > day",
            least="SELECT node, min(day) AS day FROM states WHERE day > -1000000 GROUP BY 1",
            # transfers that arrive first from where funds had arrived first
            tight="""SELECT a, b FROM moves JOIN least x ON x.node = b AND x.day = t LEFT JOIN least y ON y.node = a WHERE y.day < t OR a IN (SELECT address FROM cex)""",
            steps="SELECT address AS node, 0::BIGINT AS hops FROM cex UNION SELECT b, hops + 1 FROM steps JOIN tight ON a = node",
        ),
        "tree_profile": _with(
            f"{_PLACED} up sizes funded seen moments kids leaves inner_",
            f"""SELECT root, tree_size, {_round("depth_skewness activation_skewness activation_kurtosis time_to_gas_ratio provision_rate leaf_path_length gas_per_node asymmetry evenness pruning")}
            FROM (SELECT root, count(*) AS tree_size,
              CASE WHEN max(dv) > 0 THEN avg(pow(depth - dm, 3)) / pow(max(dv), 1.5) ELSE 0.0 END AS depth_skewness,
              coalesce(CASE WHEN max(bv) > 0 THEN avg(pow(b - bm, 3)) / pow(max(bv), 1.5) END, 0.0) AS activation_skewness,
              coalesce(CASE WHEN max(bv) > 0 THEN avg(pow(b - bm, 4)) / pow(max(bv), 2) - 3 END, 0.0) AS activation_kurtosis,
              CASE WHEN sum(g) > 0 THEN (max(b) - min(b)) / sum(g)::DOUBLE ELSE 0.0 END AS time_to_gas_ratio,
              CASE WHEN max(b) > min(b) THEN sum(g)::DOUBLE / (max(b) - min(b)) ELSE 0.0 END AS provision_rate,
              CASE WHEN sum(g) FILTER (size = 1) > 0 THEN (sum(g * depth) FILTER (size = 1))::DOUBLE / (sum(g) FILTER (size = 1))::DOUBLE ELSE 0.0 END AS leaf_path_length,
              coalesce(sum(g)::DOUBLE, 0.0) / count(*) AS gas_per_node FROM moments GROUP BY 1)
            JOIN (SELECT root, coalesce(avg((s1 - s0)::DOUBLE / s1) FILTER (k > 1), 0.0) AS asymmetry,
              coalesce(avg(CASE WHEN a1 > 0 THEN a0::DOUBLE / a1::DOUBLE ELSE 0.0 END) FILTER (k > 1), 0.0) AS evenness, avg(leaves::DOUBLE / (size - 1)) AS pruning
              FROM inner_ GROUP BY 1) USING (root)""",
            funded="SELECT activated_address AS node, sum(amount) AS amount, min(block) AS block FROM first_edge GROUP BY 1",
            seen="""SELECT p.node, p.root, p.depth, size, CASE WHEN p.depth > 0 THEN block END AS b, CASE WHEN p.depth > 0 THEN coalesce(amount, 0) END AS g, coalesce(amount, 0) AS a
              FROM placed p JOIN sizes s ON s.node = p.node LEFT JOIN funded f ON f.node = p.node""",
            moments="SELECT *, avg(depth) OVER w AS dm, var_pop(depth) OVER w AS dv, avg(b) OVER w AS bm, var_pop(b) OVER w AS bv FROM seen WINDOW w AS (PARTITION BY root)",
            kids="""SELECT gas_provider AS node, count(*) AS k, min(size) AS s0, max(size) AS s1, min(a) AS a0, max(a) AS a1 FROM tedge JOIN seen ON node = activated_address GROUP BY 1""",
            leaves="SELECT anc AS node, count(*) AS leaves FROM up u JOIN sizes s ON s.node = u.node WHERE size = 1 GROUP BY 1",
            inner_="SELECT s.root, size, k, s0, s1, a0, a1, leaves FROM seen s JOIN kids USING (node) JOIN leaves USING (node)",
        ),
        "chain_walk": _with(
            "xfer first_edge labeled interactors pmap walk walked", "SELECT *, false AS in_cycle FROM walked"
        ),
        "master_features": _master(),
        "class_counts": _with("scored", "SELECT label, count(*) AS n FROM scored GROUP BY 1"),
        "confusion_05": _with(
            "scored", "SELECT label, CAST(score > 0.5 AS INTEGER) AS prediction, count(*) AS n FROM scored GROUP BY 1, 2"
        ),
        "class_report": _report(),
        "pr_curve": _with("scored cuts pr", 'SELECT round(threshold, 6) AS threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pr'),
        "best_f1_threshold": _with(
            "scored cuts pr",
            'SELECT round(threshold, 6) AS threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pr WHERE f1 IS NOT NULL ORDER BY pr.f1 DESC, pr.threshold LIMIT 1',
        ),
        "confusion_best": _with(
            "scored cuts pr best cells",
            """SELECT a AS label, b AS prediction, coalesce(n, 0) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, b)
            LEFT JOIN cells ON label = a AND prediction = b""",
            best="SELECT threshold AS t FROM pr WHERE f1 IS NOT NULL ORDER BY f1 DESC, threshold LIMIT 1",
            cells="SELECT label, CAST(score >= t AS INTEGER) AS prediction, count(*) AS n FROM scored, best GROUP BY 1, 2",
        ),
        "roc_curve": _with(
            "scored cuts", "SELECT round(threshold, 6) AS threshold, round(CAST(fp AS DOUBLE) / neg, 6) AS fpr, round(CAST(tp AS DOUBLE) / pos, 6) AS tpr FROM cuts"
        ),
        "roc_auc": _with(
            "scored cuts",
            """SELECT round(sum((fpr - coalesce(lf, 0)) * (tpr + coalesce(lt, 0)) / 2), 6) AS auc FROM
            (SELECT *, lag(fpr) OVER w AS lf, lag(tpr) OVER w AS lt FROM
              (SELECT threshold, CAST(fp AS DOUBLE) / neg AS fpr, CAST(tp AS DOUBLE) / pos AS tpr FROM cuts) WINDOW w AS (ORDER BY threshold DESC))""",
        ),
        "split_rows": _with("sybil_set splits", "SELECT addr, sybil, split FROM splits"),
        "split_balance": _with(
            "sybil_set splits per",
            """SELECT split, sybil, CASE WHEN split = 'train' THEN max(n) OVER (PARTITION BY split) ELSE n END AS n FROM per""",
            per="SELECT split, sybil, count(*) AS n FROM splits GROUP BY 1, 2",
        ),
        "shape_report": _with(
            "xfer per one",
            """SELECT 'to_address' AS "column", a AS filled, rows, distinct_keys, repeated_rows FROM one UNION ALL
            SELECT 'from_address', b, rows, distinct_keys, repeated_rows FROM one UNION ALL SELECT 'block', c, rows, distinct_keys, repeated_rows FROM one""",
            per="""SELECT count(*) AS n, count(to_address) AS a, count(from_address) AS b, count(CASE WHEN block > 0 THEN 1 END) AS c
            FROM xfer GROUP BY to_address, from_address""",
            one="""SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_keys, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS repeated_rows,
            sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c FROM per""",
        ),
        "csv_union_by_name": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 2 THEN c_acctbal END AS c_acctbal FROM customer",
        "csv_union_all_columns": """SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 3 <> 2 THEN c_acctbal END AS c_acctbal,
            CASE WHEN c_custkey % 3 = 1 THEN 'x' END AS other FROM customer""",
        "csv_keep_first_loaded": "SELECT c_custkey, c_name, c_acctbal FROM customer",
        "csv_single_file": "SELECT c_custkey, c_name, c_acctbal FROM customer",
        "csv_empty_folder": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE false",
        "line_sets": "SELECT DISTINCT c_mktsegment AS segment FROM customer",
        "lines_sorted": "SELECT count(*) AS lines, true AS in_order FROM customer WHERE c_name IS NOT NULL",
        "replaced_table": "SELECT *, true AS expires FROM region",
        "pointer_detection": "SELECT * FROM (VALUES (false, 1::BIGINT), (true, 1::BIGINT)) v(is_pointer, files)",
        "progress_eta": """SELECT step, sum(amount) OVER w AS done, sum(amount) OVER () AS total, round(elapsed, 3) AS elapsed_s,
            round(elapsed / sum(amount) OVER w * (sum(amount) OVER () - sum(amount) OVER w), 3) + 0.0 AS left_s FROM
            (SELECT strftime(ts, '%Y-%m-%d') AS step, count(*) AS amount,
              CAST(max(floor(epoch(ts))) - epoch(TIMESTAMP '2024-01-01 00:00:00') AS DOUBLE) AS elapsed FROM events GROUP BY 1)
            WINDOW w AS (ORDER BY elapsed, step)""",
        "event_windows": """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n,
            round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS total FROM events GROUP BY 1, 2""",
        "events_first_seen": """SELECT user_id AS activated_address, event_type AS gas_provider, value AS amount,
            date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS block, event_id AS tx FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
            count(*) OVER (PARTITION BY user_id, ts) AS n FROM events WHERE value > 0) WHERE rn = 1 AND n = 1""",
    }
