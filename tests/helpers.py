"""Plain helpers of the core tests; fixtures are in conftest."""


def column(df, symbol, name, order="d"):
    return [r[name] for r in df.filter(df.symbol == symbol).orderBy(order).collect()]
