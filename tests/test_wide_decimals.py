"""Decimals that the column's scale cannot hold."""

from decimal import Decimal

from trellis.operators import wide


def test_decimals_are_not_rounded_silently(spark):
    texts = {"ten": "1.0123456789", "zeros": "-1.01234567890000", "eleven": "1.01234567891", "tiny": "0.00000000001", "whole": "7"}
    df = spark.createDataFrame([(s, "<e#size>", f'"{t}"') for s, t in texts.items()], "s string, p string, o string")
    got = {r.s: r for r in wide.widen(df, [wide.Attribute(0, "<e#size>", "decimal", "size")]).collect()}
    assert {s: r.size for s, r in got.items()} == {"ten": Decimal("1.0123456789"), "zeros": Decimal("-1.0123456789"), "eleven": None, "tiny": None, "whole": 7}
    assert {s for s, r in got.items() if r.failures == {"<e#size>": "out_of_range"}} == {"eleven", "tiny"}
    assert all(not got[s].failures for s in ("ten", "zeros", "whole"))
