import math

import numpy as np
import pytest

from cloudgrid.llm import jaccard_join


@pytest.mark.parametrize("percent", [10, 30, 50])
def test_pairs_right_at_a_low_threshold_are_all_found(spark, percent):
    rows = []
    for k in range(100):
        shared = [f"s{k}_{j}" for j in range(percent)]
        for side in range(2):
            rows.append((2 * k + side, " ".join(shared + [f"o{k}_{side}_{j}" for j in range((100 - percent) // 2)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join(df, percent, width=1).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}
    above = jaccard_join.join(df, percent + 1, width=1)
    assert all(r.doc_id == r.component_id for r in above.collect())


def test_bands_bound_the_misses():
    assert jaccard_join.bands_for(75) == (80, 5)
    for percent in range(1, 101):
        bands, rows = jaccard_join.bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= jaccard_join.MISS
        assert len(jaccard_join.band_hashes(np.arange(3, dtype=np.uint64) << np.uint64(40), bands, rows)) == bands
    for percent in (0, 101, -math.inf):
        with pytest.raises(ValueError):
            jaccard_join.bands_for(percent)
