import datetime as dt


def ts(text):
    return dt.datetime.fromisoformat(text)


def rows_of(df, *columns):
    """Rows as plain tuples, sorted."""
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=repr)


def values(df, key, column):
    return [r[column] for r in sorted(df.select(key, column).collect(), key=lambda r: r[key])]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
