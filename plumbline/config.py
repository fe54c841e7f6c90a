"""Methodology parameters. Fixed values."""

SMA = (10, 20, 40, 50, 100, 200)
EMA = (10, 20, 50, 100, 200)
RSI, ATR, ROC = 14, 14, 12
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
STOCHASTIC, STOCHASTIC_SMOOTHING, STOCHASTIC_D = 14, 3, 3
BOLLINGER, BOLLINGER_K = 20, 2.0
VOLUME_SMA, RVOL_BASE = 20, 20
VOLUME_SHORT, VOLUME_LONG, VOLUME_BAND = 10, 20, 0.10
RVOL_EXPANSION, RVOL_CONTRACTION = 1.5, 0.67
FRACTAL = {"MICRO": 1, "MINOR": 2, "INTERMEDIATE": 3, "MAJOR": 5}
ATR_MULTIPLE = {"MICRO": 1.0, "MINOR": 2.0, "INTERMEDIATE": 3.0, "MAJOR": 5.0}
PERCENT = {"MICRO": 5, "MINOR": 10, "INTERMEDIATE": 15, "MAJOR": 25}
EQUAL_ATR, BREAK_ATR, RANGE_SWINGS, RANGE_ATR = 0.25, 0.10, 4, 3.0
FIB_MIN_ATR = 2.0
RETRACEMENTS = (0.236, 0.382, 0.5, 0.618, 0.786)
EXTENSIONS = (1.272, 1.618, 2.618)
VOLATILITY_LOOKBACK, COMPRESSION, NARROW, EXPANSION_ATR, EXPANSION_WINDOW = 52, 0.20, 7, 1.5, 4
CANDLE_CONTEXT, DOJI_BODY, SHADOW_BODY, OPPOSITE_SHADOW, STAR_FIRST, STAR_MIDDLE = 5, 0.1, 2.0, 0.25, 0.6, 0.3
BREAKOUT_CONFIRM, BREAKOUT_CONTRADICT, CLIMAX_RVOL, CLIMAX_ATR, OBV_BARS, OBV_BAND = 1.5, 0.8, 2.5, 2.0, 10, 0.10
DIVERGENCE_BARS, RSI_DELTA, DIVERGENCE_EXPIRY = (4, 52), 2.0, 26
DOUBLE = {"equal": 0.5, "least": 4, "most": 60, "height": 2.0, "wait": 26}
TRIPLE = {"equal": 0.5, "least": 8, "most": 90, "height": 2.0, "wait": 26}
V_SHAPE = {"move": 4.0, "bars": 8, "recovery": 0.618, "wait": 8}
RECTANGLE = {"band": 0.75, "height": 2.0, "least": 8, "most": 104, "wait": 52}
SHOULDERS = {"prominence": 1.0, "shoulder": 1.5, "balance": (0.4, 2.5), "slope": 0.25, "height": 2.0, "most": 104, "wait": 26}
TRENDLINE_BARS, TRENDLINE_TOUCH = (4, 104), 0.5
ZONE_TOLERANCE, ZONE_WIDTH, ZONES_A_SIDE, RECENCY = 0.5, 0.25, 4, 26.0
RETEST_WINDOW, RETEST_ATR, FALSE_WINDOW = 10, 0.5, 3
MOVE_WARN, MOVE_BREAK, GAP_SESSIONS, MISSING_RATIO = 0.25, 0.5, 65, 0.02
SIGMA_WINDOW, SIGMA_MULTIPLE, TOLERANCE = 250, 5.0, 0.15
CONVERGING = {"flat": 0.02, "symmetry": 3.0, "converge": 0.75, "apex": 52, "height": 2.0, "least": 8, "most": 104, "wait": 52, "touch": 0.5}
FLAG = {"pole": 3.0, "pole_bars": 6, "least": 3, "most": 12, "retrace": 0.5, "parallel": 0.05, "flat": 0.02, "converge": 0.75, "touch": 0.5}
ROUNDING = {"rim": 2.0, "least": 20, "most": 156, "r2": 0.6, "vertex": (0.25, 0.75), "depth": 3.0, "low": 0.5, "wait": 26}
CUP = {"rim": 2.0, "least": 7, "most": 65, "depth": 3.0, "ratio": 0.5, "r2": 0.5, "handle": (1, 10), "handle_ratio": 0.5, "wait": 13}
BREAKOUT_ATR, FAIL_WINDOW, COMPLETION_WINDOW, MOVE_ZONE_ATR = 0.25, 8, 52, 0.5
NEW_BARS, RECENT_BARS, APPROACH_ATR, FORMING_A_TYPE = 4, 4, 1.0, 2
ZONE_WEIGHTS = {"touch": 1.0, "sources": 1.0, "volume": 0.5, "recency": 2.0}
FIB_IN_ZONES = (0.382, 0.5, 0.618)
TRENDLINES_A_SIDE = 2
MACD_DELTA, OBV_DELTA, VOLUME_DROP = 0.05, 0.05, 0.10
