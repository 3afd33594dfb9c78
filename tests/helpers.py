def rows(df, *order):
    """Rows as tuples, sorted by the given columns (all by default), NULLs first."""
    columns = order or df.columns
    key = lambda r: [(r[c] is not None, r[c]) for c in columns]
    return [tuple(r) for r in sorted(df.collect(), key=key)]


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
