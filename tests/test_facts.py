"""Slices that are settled hold the same rows as those cleaned again."""

from stratagraph import facts
from stratagraph.operators import metrics, rank


def test_settled_slices_change_no_rows(spark, sf, monkeypatch):
    def rows(settle, size):
        monkeypatch.setattr(facts, "SETTLE_BYTES", size)
        f = facts.Facts(spark, sf, settle)
        return sorted(map(tuple, metrics.package_metrics(f).collect())), sorted(map(tuple, rank.top_functions(f).select("symbol_key", "score").collect())), len(f._written)

    again, far = rows(True, 1 << 60), rows(True, 0)
    assert again[:2] == far[:2] and again[2] == 0 and far[2] > 0
