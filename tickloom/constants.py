"""They must equal what is on the wire, so they stand here as plain text."""

# Native currency (wrapped) and its decimals.
NATIVE_MINT = "So11111111111111111111111111111111111111112"
NATIVE_DECIMALS = 9
DEFAULT_TOKEN_DECIMALS = 6

# Protocol, event type, market type and stage names as stored in the log.
CURVE = "pumpfun"
AMM = "pumpamm"
CURVE_MARKET = "pumpfun_curve"
AMM_MARKET = "pumpamm_pool"
STAGE_CURVE = "bonding_curve"
STAGE_POOL = "pool"
CHAIN = "solana"
COMMITMENT = "processed"
SCHEMA_VERSION = 1

# Program addresses.
CURVE_PROGRAM = "6EF8rrecthR5Dkzon8Nwu78hRvfCKubJ14M5uBEwF6P"
AMM_PROGRAM = "pAMMBay6oceH9fJKBRHGP5D4bD4sWpmSwMn52FMfXEA"
TOKEN_PROGRAM = "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA"
TOKEN_2022_PROGRAM = "TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb"
INITIALIZE_MINT_TYPE = 20

# Prefix of a log line that carries an event.
LOG_DATA_PREFIX = "Program data: "

# Enumerations of the binary envelope, position = wire number, 0 = unspecified.
CHAIN_NAMES = ["", "solana"]
PROTOCOL_NAMES = ["", "pumpfun", "pumpamm"]
EVENT_TYPE_NAMES = ["", "trade", "create", "migrate", "swap", "create_pool", "deposit", "withdraw"]
COMMITMENT_NAMES = ["", "processed", "confirmed", "finalized"]
INSTRUCTION_SOURCE_NAMES = ["", "outer", "inner"]
EVENT_ORIGIN_NAMES = ["", "logs", "inner_cpi"]

# Gateway that replaces the ipfs scheme.
IPFS_SCHEME = "ipfs://"
IPFS_GATEWAY = "https://ipfs.io/ipfs/"

# Candle sizes in seconds, and the finer size each one is rolled up from.
RESOLUTIONS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
ROLLUP_FROM = {"5m": "1m", "15m": "5m", "1h": "15m", "4h": "1h", "1d": "4h"}

# Rolling windows in seconds.
SHORT_WINDOWS = {"1m": 60, "5m": 300}
LONG_WINDOWS = {"1h": 3600, "4h": 14400, "24h": 86400}
WINDOWS = {**SHORT_WINDOWS, **LONG_WINDOWS}
SHORT_SPAN = 300
STATE_TTL = 86400

# Upper bounds of the latency histogram, milliseconds.
LATENCY_BOUNDS = [5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000]

# Heat thresholds: warm, hot, blazing.
VOLUME_HEAT = (18.29, 55.85, 93.28)
TXN_HEAT = (28.0, 89.0, 162.0)
LIQUIDITY_HEAT = (22.69, 30.0, 34.37)
MARKET_CAP_HEAT = (28.29, 31.07, 46.15)
