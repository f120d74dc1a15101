"""Comparison of DataFrames with expected rows."""


def rows(df, names=None):
    """Sorted rows of a DataFrame, columns by name."""
    names = sorted(names or df.columns)
    return sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def same(df, found):
    """Whether a DataFrame holds the oracle's (names, rows)."""
    names, want = found
    at = [names.index(n) for n in sorted(names)]
    assert sorted(df.columns) == sorted(names)
    assert rows(df) == sorted((tuple(r[i] for i in at) for r in want), key=repr)
