"""Schemas of the datasets, as DDL strings, and a check that a DataFrame has one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SYMBOLS = "symbol_id int, symbol string, name string, isin string, industry string, active boolean"
BARS = "symbol_id int, timeframe string, ts timestamp, open double, high double, low double, close double, volume bigint, source string, price_basis string"
ACTIONS = "symbol_id int, action_type string, ex_date date, record_date date, value double, ratio_from double, ratio_to double, price_factor double, is_extraordinary boolean, affects_share_count boolean, subject string"
SIGNALS = "symbol_id int, timeframe string, strategy string, ts timestamp, entry double, stop_loss double, target_1 double, target_2 double, risk_pct double, details string"
TRADES = "trade_id bigint, account_id int, symbol_id int, side string, quantity bigint, price double, trade_ts timestamp, trade_date date, applied_at timestamp"
POSITIONS = "position_id bigint, account_id int, symbol_id int, opened_on date, qty_total bigint, qty_open bigint, avg_entry_price double, status string"
CHECKS = "symbol_id int, day date, timeframe string, status string, note string"
SESSIONS = "session_date date, session_no int, open_ts timestamp, close_ts timestamp"
#: The official daily file, 34 columns.
DAILY_FILE = (
    "TradDt date, BizDt date, Sgmt string, Src string, FinInstrmTp string, FinInstrmId bigint, ISIN string, TckrSymb string, SctySrs string, "
    "XpryDt string, FininstrmActlXpryDt string, StrkPric string, OptnTp string, FinInstrmNm string, OpnPric double, HghPric double, LwPric double, "
    "ClsPric double, LastPric double, PrvsClsgPric double, UndrlygPric double, SttlmPric double, OpnIntrst double, ChngInOpnIntrst double, "
    "TtlTradgVol bigint, TtlTrfVal double, TtlNbOfTxsExctd bigint, SsnId string, NewBrdLotQty bigint, Rmks string, Rsvd1 string, Rsvd2 string, "
    "Rsvd3 string, Rsvd4 string"
)


def assert_schema(df: DataFrame, ddl: str) -> DataFrame:
    """df, if it has all columns of the schema with their types; else an error that names the differences."""
    have = dict(df.dtypes)
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl) if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"missing or of another type: {', '.join(wrong)}")
    return df
