"""Named factor formulas. Windows are parameters, as panels differ in grain."""

from __future__ import annotations

from panelweave.plans.formula import add, divide, lit_node, multiply, negative, rank, rolling_mean, rolling_return, rolling_std, subtract


def momentum(close="close", window=20):
    return rank(rolling_return(close, window))


def reversal(close="close", window=5):
    return negative(rolling_return(close, window))


def low_volatility(close="close", window=20):
    return negative(rank(rolling_std(close, window)))


def volatility(close="close", window=60):
    return rank(rolling_std(rolling_return(close, 1), window))


def illiquidity(close="close", amount="amount", window=20):
    return rank(rolling_mean(divide(rolling_return(close, 1), amount), window))


def amount_illiquidity(amount="amount", window=20):
    return rank(negative(rolling_mean(amount, window)))


def high_low_range(high="high", low="low", close="close", window=20):
    return rank(rolling_mean(divide(subtract(high, low), close), window))


def turnover_mean(turnover="turnover", window=20):
    return rank(rolling_mean(turnover, window))


def price_volume(close="close", volume="total_turnover", window=20):
    half = lit_node(0.5)
    return add(multiply(half, rank(rolling_return(close, window))), multiply(half, rank(rolling_std(volume, window))))


def accruals(net_profit="net_profit", cfo="cfo", assets="tot_assets"):
    return rank(divide(subtract(net_profit, cfo), assets))


def ratio_rank(a, b):
    """Asset turnover, leverage, current ratio, cash to profit, earnings to price."""
    return rank(divide(a, b))


def cheapness(x):
    """Value from one price multiple: a lower multiple ranks higher."""
    return rank(negative(x))


def metric_rank(x):
    """Quality or growth from one point-in-time metric."""
    return rank(x)


def quality_value(quality, multiple):
    return add(rank(quality), rank(negative(multiple)))


def quality_less_value(quality, multiple):
    return add(rank(quality), negative(rank(multiple)))


def value_momentum(multiple, close="close", window=20):
    return add(rank(negative(multiple)), rank(rolling_return(close, window)))


def quality_growth(quality, growth):
    return add(rank(quality), rank(growth))


def triple(a, b, c, close_window=20):
    return add(add(rank(a), rank(negative(b))), rank(rolling_return(c, close_window)))
