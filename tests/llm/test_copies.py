"""op10: copies of one vector don't push a nearer vector out of the rerank."""

import numpy as np

from metaweave.llm import nearest

from .test_recall import results, stored, truth


def test_copies_leave_room(spark, tmp_path, monkeypatch):
    gen = np.random.default_rng(3)
    x = gen.normal(size=(700, 16)).astype(np.float32)
    x[0] = 0
    x[0, 0] = 1  # the query
    x[100:600] = x[0] + 0.3 * np.eye(16)[1]  # 500 copies, near it
    x[600:603] = x[0] + 0.05 * np.eye(16)[2] * np.arange(1, 4)[:, None]  # three truly nearer vectors
    x[5] = x[100]
    real = nearest.encode

    def coarse(v, books, beam=nearest.BEAM):
        """The copies' approximate score passes that of the nearer vectors."""
        codes, norms = real(v, books, beam)
        return codes, np.where(np.abs(v[:, 1] - 0.3 / np.sqrt(1.09)) < 1e-6, norms * 0.5, norms)

    monkeypatch.setattr(nearest, "encode", coarse)
    df = stored(spark, tmp_path, x)
    got = results(nearest.search(df, df["vec_id"].isin(0, 5, 100, 300)))
    assert got[0] == truth(x, 0) and set(got[0][:3]) == {600, 601, 602}
    assert got[5] == [100, 101, 102, 103, 104] and got[100] == [5, 101, 102, 103, 104] and got[300] == [5, 100, 101, 102, 103]
