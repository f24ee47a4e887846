"""Schemas of recorded events and of the tables derived from them."""

from __future__ import annotations

# One recorded event; the payload stays JSON text because its shape depends on event_type.
ENVELOPE = (
    "schema_version int, receive_ts_ms bigint, exchange_ts_ms bigint, source string, event_type string, payload string"
)

# Position of an event inside its market window: fragment, block of the file, line.
ORDER = ["frag", "block", "line"]

# Fields read from payloads.  Leaves are text: writers mix numbers and strings.
PAYLOAD = """
type string, seq string, sid string,
price string, mid string, microprice string, depth_imbalance string, status string,
msg struct<
  market_ticker string, side string, price_dollars string, delta_fp string,
  yes_dollars_fp array<array<string>>, no_dollars_fp array<array<string>>,
  yes_price_dollars string, count_fp string, count string, taker_book_side string, book_side string,
  yes_bid_dollars string, yes_ask_dollars string, ts_ms string,
  is_taker string, action string, channel string, index_id string, data string,
  avg_60s_data struct<value string>,
  last_60s_windowed_average_15min struct<value string, window_size string, window_end_ts_exclusive string>>
"""

MARKET = """
ticker string, event_ticker string, title string, status string, open_time string, close_time string,
expected_expiration_time string, floor_strike string, rules_primary string, rules_secondary string, result string,
price_ranges array<struct<start:string,end:string,step:string>>
"""

INDEX_ID = "BRTI"
INDEX_EVENT = "cfbenchmarks_value"
VENUES = ("binance", "coinbase", "kraken")

FEATURE_SCHEMA_VERSION = 1
FEATURE_COLUMNS = [
    "schema_version", "ticker", "ts_ms", "seconds_to_close", "mid", "spread", "bid", "ask", "bid_size", "ask_size",
    "microprice_minus_mid", "imb_top1", "imb_top3", "depth_top3", "bid_size_delta", "ask_size_delta",
    "flow_1s", "flow_5s", "flow_30s", "trades_5s", "last_trade_age_ms",
    "brti", "ext_basis_bps", "ext_dispersion_bps", "ext_micro_lead_bps", "ext_imbalance", "ext_venues_fresh",
    "sigma_per_s", "jump_ratio", "z_moneyness", "gbm_fair", "gbm_fair_minus_mid", "final_minute_count",
    "outcome_yes", "quality_flags", "fwd_mid_delta_1s", "fwd_mid_delta_5s", "fwd_mid_delta_30s",
]
