"""Schemas, feature lists, fixed values and run parameters.

Every job in the package is a function ``DataFrame -> DataFrame``; the values
below are the only constants they share.  Domain lists (exclusions, platform
names, chain names, labels) are kept as data so that the jobs stay generic.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

#: Bridge transaction table, columns in file order.
TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("created_at", T.TimestampType()),
        T.StructField("wallet", T.StringType()),
        T.StructField("execution_kind", T.StringType()),
        T.StructField("is_call", T.BooleanType()),
        T.StructField("route_source", T.StringType()),
        T.StructField("deposit_tx_hash", T.StringType()),
        T.StructField("origin_chain_name", T.StringType()),
        T.StructField("user_send_currency", T.StringType()),
        T.StructField("user_send_currency_amount", T.DoubleType()),
        T.StructField("user_send_currency_usd", T.DoubleType()),
        T.StructField("destination_chain_name", T.StringType()),
        T.StructField("fill_tx_hash", T.StringType()),
        T.StructField("user_receive_currency_amount", T.DoubleType()),
        T.StructField("user_receive_currency_usd", T.DoubleType()),
        T.StructField("user_receive_currency", T.StringType()),
    ]
)
TRANSACTION_COLUMNS = [f.name for f in TRANSACTION_SCHEMA.fields]

#: Raw competitor bridge activity (warehouse extract input).
COMPETITOR_RAW_SCHEMA = T.StructType(
    [
        T.StructField("source_address", T.StringType()),
        T.StructField("source_chain", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("destination_chain", T.StringType()),
        T.StructField("amount_usd", T.DoubleType()),
        T.StructField("tx_hash", T.StringType()),
        T.StructField("block_timestamp", T.TimestampType()),
        T.StructField("direction", T.StringType()),
        T.StructField("token_is_verified", T.BooleanType()),
    ]
)

#: Competitor usage at wallet x platform x route grain (extract output).
COMPETITOR_USAGE_SCHEMA = T.StructType(
    [
        T.StructField("wallet_", T.StringType()),
        T.StructField("source_chain", T.StringType()),
        T.StructField("platform_", T.StringType()),
        T.StructField("destination_chain", T.StringType()),
        T.StructField("amount_usd", T.DoubleType()),
        T.StructField("tx_count", T.LongType()),
    ]
)
COMPETITOR_USAGE_COLUMNS = [f.name for f in COMPETITOR_USAGE_SCHEMA.fields]

EXCLUSION_SCHEMA = T.StructType(
    [T.StructField("wallet", T.StringType()), T.StructField("reasoning", T.StringType())]
)

# ---------------------------------------------------------------------------
# Feature lists
# ---------------------------------------------------------------------------

#: Wallet features, variant A (all rows, NOT EXISTS exclusion).
FEATURES_A = [
    "origin_chains", "dest_chains", "currency_sends", "call_count", "distinct_routes",
    "cross_chain_swaps", "bridges", "unique_days", "deposit_tx_count",
    "total_send_usd", "total_receive_usd",
]
#: The nine behaviour features shared by both variants and all profiles.
BUSINESS_FEATURES = [
    "origin_chains", "dest_chains", "currency_sends", "call_count", "distinct_routes",
    "cross_chain_swaps", "bridges", "unique_days", "total_send_usd",
]
#: Heavy-tailed features that get a log column.
LOG_FEATURES = ["call_count", "cross_chain_swaps", "bridges", "total_send_usd"]
#: Clustering inputs: business features with the heavy-tailed ones logged.
CLUSTER_FEATURES = [f"{c}_log" if c in LOG_FEATURES else c for c in BUSINESS_FEATURES]
#: Feature order of the persona characteristics table.
REPORT_FEATURES = [
    "origin_chains", "dest_chains", "call_count", "bridges", "cross_chain_swaps",
    "currency_sends", "unique_days", "total_send_usd",
]
#: Metrics of the loyalty profile table.
LOYALTY_METRICS = BUSINESS_FEATURES + ["n_platforms", "total_amount_usd", "total_tx_count"]

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's values for equal results)
# ---------------------------------------------------------------------------

# Programmatic / burn wallets excluded from all analyses, with reason.
REFERENCE_EXCLUSIONS = [
    ("0x1231deb6f5749ef6ce6943a275a1d3e7486f4eae", "LiFi-Diamond"),
    ("0x4f8c9056bb8a3616693a76922fa35d53c056e5b3", "LiFi-Diamond"),
    ("0xde1e598b81620773454588b85d6b5d4eec32573e", "LiFi-Diamond"),
    ("0x864b314d4c5a0399368609581d3e8933a63b9232", "LiFi-Diamond"),
    ("0x341e94069f53234fe6dabef707ad424830525715", "LiFi-Diamond"),
    ("0x896ff3b31ecc105d4f23582c73416484ecc207c6", "LiFi-Diamond"),
    ("0xf909c4ae16622898b885b89d7f839e0244851c66", "LiFi-Diamond"),
    ("72z3PVWqpzyDd4CQGsQJU6eGt6fLq4D3ULrSKdMULyY8", "thaolunar.sol"),
    ("zApVWDs3nSychNnUXSS2czhY78Ycopa15zELrK2gAdM", "thaolunar.sol"),
    ("5trW3ZogRMxW9tX4pNCMQi1APzx8G6UTcyneWEX2Rk4Q", "thaolunar.sol"),
    ("9s3Kyeg2NHeM2xhSqMyp944f8VS2oBYdwvK98AAnW35w", "thaolunar.sol"),
    ("0x0000000000000000000000000000000000000000", "burn-address"),
    ("0x000000000000000000000000000000000000dead", "burn-address"),
]
# Competitor platforms kept by the extract (case-exact IN list).
REFERENCE_COMPETITOR_PLATFORMS = ["across-v3", "dln_debridge", "deBridge"]
# Chains kept on both ends of a competitor route.
REFERENCE_CHAINS = [
    "base", "bsc", "solana", "arbitrum", "optimism", "ethereum", "polygon",
    "zora", "appchain", "eclipse", "soneium", "abstract",
]
# Platform label normalization (case-insensitive pattern -> label).
PLATFORM_PATTERN = "%debridge%"
PLATFORM_PATTERN_LABEL = "deBridge"
# Execution kinds counted as features.
KIND_BRIDGE = "Bridge"
KIND_CROSS_CHAIN_SWAP = "Cross chain swap"
# Persona labels, in PC1 rank order (highest first; rest by PC1 sign).
PERSONA_TOP = "Multi-Chain Users"
PERSONA_POSITIVE = "High Value Users"
PERSONA_OTHER = "Basic Bridge Users"
PERSONAS = [PERSONA_OTHER, PERSONA_POSITIVE, PERSONA_TOP]
# Loyalty label for wallets seen on more than one platform.
LOYALTY_MULTI = "multi-platform"
# Volume segments (>= P99, >= P90, rest).
SEGMENT_TOP1 = "Programmatic (Top 1%)"
SEGMENT_TOP10 = "Core Users (Top 10%)"
SEGMENT_REST = "The Masses (Bottom 90%)"
# Rule segments in test order (the first has a wording of its own).
RULE_NEW = "New User"
RULE_PROGRAMMATIC = "Advanced Programmatic"
RULE_BEGINNER = "Beginner Explorer"
RULE_REGULAR = "Regular User"
# Display names of the report columns.
DISPLAY_NAMES = {
    "origin_chains": "# Origins",
    "dest_chains": "# Destinations",
    "call_count": "# F() Calls",
    "bridges": "# Simple Bridge",
    "cross_chain_swaps": "# Cross Chain Swaps",
    "currency_sends": "# Tokens",
    "unique_days": "# Unique Days",
    "total_send_usd": "6-mo Volume",
}
# Published PCA loadings (rows PC1..PC5, columns in CLUSTER_FEATURES order:
# origin_chains, dest_chains, currency_sends, call_count_log, distinct_routes,
# cross_chain_swaps_log, bridges_log, unique_days, total_send_usd_log).
PUBLISHED_LOADINGS = [
    [0.380, 0.390, 0.356, 0.233, 0.377, 0.331, 0.312, 0.365, 0.201],
    [0.074, -0.103, 0.146, -0.680, -0.060, -0.018, -0.074, 0.084, 0.695],
    [0.109, 0.097, -0.268, 0.080, -0.266, -0.565, 0.688, 0.106, 0.160],
    [-0.267, -0.036, -0.306, 0.552, -0.014, 0.224, -0.075, -0.220, 0.651],
    [-0.198, 0.157, -0.459, -0.105, -0.293, 0.303, -0.113, 0.720, -0.079],
]
# Published k-means centroids in (PC1, PC2, PC3), clusters 0, 1, 2.
PUBLISHED_CENTROIDS = [(2.784, -0.203, 0.442), (9.106, -0.084, -0.555), (-0.897, 0.039, -0.051)]
# Centroids that give three non-empty personas on the driver tables (fixture values).
DRIVER_CENTROIDS = [(0.9, -0.2, 0.4), (3.0, -0.1, -0.5), (-2.0, 0.0, 0.0)]


# ---------------------------------------------------------------------------
# Run parameters
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Run parameters.  ``reference()`` gives the published settings; the
    defaults are the settings that exercise every branch on the driver tables."""

    home_platform: str = "home"
    #: home activity window [start, end); end None = open (files end the window)
    window_start: str = "1996-01-01"
    window_end: str | None = None
    #: competitor extract window [start, end)
    competitor_start: str = "2024-01-01"
    competitor_end: str = "2024-02-01"
    competitor_platforms: tuple = tuple(REFERENCE_COMPETITOR_PLATFORMS)
    chains: tuple = tuple(f"NATION_{i}" for i in range(24))
    retain_from: str = "1996-01-01"
    top_k_wallets: int = 100
    rule_new_max: int = 18
    rule_programmatic_min: int = 80
    rule_beginner_max_chains: int = 12
    advanced_min: int = 50
    heavy_min_tx: int = 60
    heavy_top_k: int = 3
    recent_n: int = 5
    first_top_n: int = 10
    preview_n: int = 10
    lookup_wallet: str = "w920"
    lookup_origin: str = "NATION_14"
    lookup_dest: str = "NATION_17"
    sample_per_cluster: int = 50
    sample_seed: int = 42
    sample_abs_bound: float = 10.0
    n_components: int = 5
    k: int = 3
    k_min: int = 2
    k_max: int = 8
    kmeans_restarts: int = 10
    kmeans_seed: int = 42
    kmeans_max_iter: int = 300
    sweep_restarts: int = 10
    centroids: tuple = tuple(DRIVER_CENTROIDS)
    #: persona model: "fixed" (given loadings + centroids) or "fitted" (Spark ML)
    model: str = "fixed"
    loadings: tuple = tuple(tuple(r) for r in PUBLISHED_LOADINGS)
    #: distinct-count strategy for the wallet features: "exact" or "set"
    distinct_mode: str = "exact"
    #: a session ends where a wallet pauses for longer
    session_gap_days: float = 30.0
    #: campaigns: days from each chain's days of most volume
    campaigns_per_chain: int = 3
    campaign_days: int = 14
    #: rows of a wallet that one task may sort; wallets with more are cut into time slices
    slice_rows: int = 2_000_000
    #: rows before this time are the first load of the incremental features
    first_load_end: str = "1999-01-01"
    #: stage the adapter output once per session as a Parquet table
    stage_inputs: bool = True

    @property
    def home_only_label(self) -> str:
        return f"{self.home_platform}-only"

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    @classmethod
    def reference(cls) -> "Params":
        """The published thresholds (real data, 2025 H1)."""
        return cls(
            window_start="2025-01-01",
            competitor_start="2025-01-01",
            competitor_end="2025-07-01",
            chains=tuple(REFERENCE_CHAINS),
            retain_from="2025-01-01",
            top_k_wallets=1000,
            rule_new_max=5,
            rule_programmatic_min=1000,
            rule_beginner_max_chains=2,
            advanced_min=100,
            heavy_min_tx=10000,
            session_gap_days=7.0,
            first_load_end="2025-04-01",
            sample_per_cluster=1000,
            centroids=tuple(PUBLISHED_CENTROIDS),
            model="fitted",
        )


DEFAULT = Params()
