"""Rows at the edge, for tests of operators over documents."""

LONG = " ".join(f"w{i * 7919 % 3000}" for i in range(12_000))
#: Null, empty and blank texts, one word, repeats, a long text, other white space, no letters, marks, other planes, a null id.
EDGE = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "same words " * 30), (6, "same words " * 30), (6, "same words " * 30), (7, LONG), (8, "a\x0bb\x0cc d e"), (9, "1234 5678 !!"),
    (10, "text with <P> in it"), (11, "<S>"), (12, "<M"), (13, "ﬁ Ａ ½ \x00 ▁▁ é😀 \U0001f468‍\U0001f469"), (14, "😀" * 5000), (15, "x́" * 3000 + "\n" * 50), (None, "no id here"), (None, None), (16, "a" * 9000),
]


def clashing(df):
    """The table with columns whose names operators may use themselves."""
    from pyspark.sql import functions as F

    for name in ("n", "form", "runs", "shard", "size", "t", "c", "r", "node", "output", "collapsed", "row", "at", "part", "slot", "_w", "_h", "h", "g"):
        df = df.withColumn(name, F.lit("own"))
    return df
