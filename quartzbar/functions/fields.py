"""Names of the bar quantities, as archives, collectors and feeds spell them."""

from __future__ import annotations

# Column orders of the archive files and of the collector's files.
ARCHIVE_CSV_FIELDS = (
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume",
    "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore",
)
COLLECTED_CSV_FIELDS = (
    "open_time", "open", "high", "low", "close", "volume", "quote_volume",
    "number_of_trades", "taker_buy_base_volume", "taker_buy_quote_volume",
)

# Spellings of each quantity. Names are case-sensitive: v is a volume, V a taker volume.
SPELLINGS: dict[str, tuple[str, ...]] = {
    "open_time": ("open_time", "openTime", "open_ts", "bar_start", "kline_open", "t"),
    "open": ("open", "o", "open_px", "first"),
    "high": ("high", "h", "high_px", "max_price"),
    "low": ("low", "l", "low_px", "min_price"),
    "close": ("close", "c", "close_px", "last"),
    "volume": ("volume", "v", "vol", "baseVol", "base_volume"),
    "close_time": ("close_time", "closeTime", "close_ts", "bar_end", "kline_close", "T"),
    "quote_volume": ("quote_volume", "q", "quote_vol", "quoteVol", "quoteAssetVolume", "quoteVolume", "turnover"),
    "count": ("count", "number_of_trades", "numberOfTrades", "n", "num_trades", "trades", "tradeCount", "trade_count"),
    "taker_buy_volume": (
        "taker_buy_volume", "taker_buy_base_volume", "takerBuyBaseVolume", "takerBuyVolume",
        "V", "buy_base_vol", "tbv", "tbbv",
    ),
    "taker_buy_quote_volume": ("taker_buy_quote_volume", "takerBuyQuoteVolume", "Q", "buy_quote_vol", "tbqv"),
    "ignore": ("ignore", "B", "unused", "reserved"),
}

QUANTITY_OF: dict[str, str] = {name: field for field, names in SPELLINGS.items() for name in names}
EPOCH_FIELDS = ("open_time", "close_time")

# Words of column names that mean the same, and what the words of a name together mean.
WORDS: dict[str, tuple[str, ...]] = {
    "volume": ("volume", "volumes", "vol", "qty", "quantity", "amount", "amt", "size"),
    "count": ("count", "cnt", "number", "num"),
    "trade": ("trade", "trades"),
    "time": ("time", "ts", "timestamp"),
    "start": ("start", "begin", "from"),
    "end": ("end", "until", "to"),
    "bar": ("bar", "kline", "candle", "candlestick"),
    "price": ("price", "px"),
    "high": ("high", "max", "highest"),
    "low": ("low", "min", "lowest"),
    "open": ("open", "first", "opening"),
    "close": ("close", "last", "closing"),
    "quote": ("quote",),
    "base": ("base",),
    "taker": ("taker",),
    "buy": ("buy",),
    "": ("asset", "of"),
}
WORD_OF: dict[str, str] = {w: meaning for meaning, words in WORDS.items() for w in words}


def _meanings() -> dict[str, str]:
    """The sorted words of a name -> the quantity that they mean together."""
    out: dict[str, str] = {}

    def add(quantity: str, *choices: str) -> None:
        for words in choices:
            out[" ".join(sorted(words.split()))] = quantity

    for price in ("open", "high", "low", "close"):
        add(price, price, f"{price} price", f"bar {price}", f"bar {price} price")
    for side, quantity in (("open", "open_time"), ("close", "close_time")):
        edge = "start" if side == "open" else "end"
        add(quantity, f"{side} time", f"bar {side} time", f"{edge} time", f"bar {edge} time", f"bar {edge}")
    add("volume", "volume", "base volume", "volume trade", "bar volume")
    add("quote_volume", "quote volume", "turnover")
    add("count", "count trade")
    for who in ("buy taker", "buy", "taker"):
        add("taker_buy_volume", f"{who} volume", f"{who} base", f"{who} base volume")
        add("taker_buy_quote_volume", f"{who} quote", f"{who} quote volume")
    return out


MEANINGS = _meanings()
