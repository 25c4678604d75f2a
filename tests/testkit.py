"""What the test modules share (fixtures are in conftest.py, which nothing imports)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def rows(df, *cols):
    """Collected rows as tuples, sorted (order-insensitive compare)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=repr)
