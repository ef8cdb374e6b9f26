"""Assembly of the feature matrix: provider flags, forest, exchange, truth and walk columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .labels import flag_membership, member_set
from .walks import chain_walk

#: The model's features in the order that breaks ties of importance (fixed values).
FEATURES = """
min_tx_value_out gini_coefficient cex_in_count leaf_gas_distribution_entropy star_like_ratio provider_is_star_like_attack
leaf_gas_distribution_skewness interactors_in_chain provider_is_labeled provider_is_interactor l0_to_eth_avg_native_drop_usd
l0_to_eth_max_native_drop_usd balance_factor l0_tx_time_span latest_l0_tx_time time_span_in
provider_total_gas_provision_amount l0_avg_stargate_swap avg_depth breadth_factor indegree_per_block_in
gas_distribution_skewness tree_size l0_min_stargate_swap provider_max_gas_provision_amount total_gas num_transactions_in
branching_factor l0_to_eth_tx_time_span n_l0_to_eth_source_contracts n_l0_to_eth_projects provider_is_null max_depth
leaf_provision_proportion n_l0_to_eth_project_per_source_chain n_l0_to_eth_txs earliest_l0_tx_time n_l0_projects
n_l0_to_eth_dest_contracts provider_fan_out l0_to_eth_min_stargate_swap n_l0_source_chains longest_chain_ratio
n_eth_interactions provider_avg_gas_provision_amount gas_distribution_entropy sparsity max_tx_value_out
n_l0_source_contracts gas_provision_block_number min_tx_value_in tx_value_per_block_out chain_length
provider_min_gas_provision_amount n_l0_to_eth_source_chains depth l0_to_eth_max_stargate_swap breadth_to_depth_ratio
leaf_to_internal_ratio earliest_tx_block_in n_l0_project_per_source_chain l0_to_eth_avg_stargate_swap is_provider
""".split()


def provider_flags(df: DataFrame, provider_of: DataFrame, labeled: DataFrame, cex: DataFrame, interactors: DataFrame) -> DataFrame:
    """Adds the provider of ``addr`` and what is known of it; no provider: flags are false.

    What is known is looked up for pairs of address and provider, so the wide
    rows of ``df`` are joined, and shuffled, by address alone.
    """
    looked_up = provider_of.select(F.col("activated_address").alias("addr"), "gas_provider")
    flags = {"provider_is_labeled": labeled, "provider_is_cex": cex, "provider_is_interactor": interactors}
    known = None
    for i, members in enumerate(flags.values()):
        own = members.select(F.col(members.columns[0]).alias("_provider"), *[F.lit(i == j).alias(f) for j, f in enumerate(flags)])
        known = own if known is None else known.unionByName(own)
    # one row per address of any set, joined once; pairs without a provider are set aside, as they would all share a key
    known = known.filter("_provider IS NOT NULL").groupBy("_provider").agg(*[F.bool_or(f).alias(f) for f in flags])
    found = looked_up.filter("gas_provider IS NOT NULL").join(known, F.col("gas_provider") == F.col("_provider"), "left").drop("_provider")
    looked_up = found.unionByName(looked_up.filter("gas_provider IS NULL"), allowMissingColumns=True)
    out = df.join(looked_up, "addr", "left").withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
    return out.withColumn("provider_is_null", F.col("gas_provider").isNull())


def is_provider(df: DataFrame, provider_of: DataFrame) -> DataFrame:
    return flag_membership(df, "addr", member_set(provider_of, "gas_provider"), "is_provider")


def fill_zero(df: DataFrame) -> DataFrame:
    """Null becomes 0 in numeric and false in boolean columns; NaN becomes 0."""
    kinds = dict(df.dtypes)
    floats = [c for c, t in kinds.items() if t in ("double", "float")]
    df = df.withColumns({c: F.nanvl(c, F.lit(0.0)) for c in floats}) if floats else df
    return df.fillna(0).fillna(False)


def master_features(
    behaviour: DataFrame, provider_of: DataFrame, star: DataFrame, members: DataFrame, exchange: DataFrame,
    first_edges: DataFrame, sybil: DataFrame, labeled: DataFrame, cex: DataFrame,
) -> DataFrame:
    """One row per behaviour address that has exchange features (inner join), all 63 features and ``sybil``.

    Forest features join left and default to 0; roots, having no parent, get 0
    too.  Interactors are the frame's own addresses: for the provider's flag all
    behaviour addresses, for the walk those that are left after the join.
    """
    provision = first_edges.select(
        F.col("activated_address").alias("addr"), F.col("block").cast("long").alias("gas_provision_block_number")
    )
    own_star = star.drop("gas_provider", "amount").withColumnRenamed("activated_address", "addr")
    df = provider_flags(behaviour, provider_of, labeled, cex, member_set(behaviour, "addr"))
    for part in (own_star, members, provision):
        df = df.join(part, "addr", "left")
    df = fill_zero(df)
    df = df.join(exchange.withColumnRenamed("to_address", "addr"), "addr", "inner")
    df = materialize(is_provider(flag_membership(df, "addr", sybil, "sybil"), provider_of), "assembled")  # the walk reads it too
    walked = chain_walk(df.select("addr"), provider_of, member_set(df, "addr"), labeled).drop("in_cycle")
    return fill_zero(df.join(walked, "addr", "left"))
