"""op1 against its SQL on vectors that do link, and on vectors that may not."""

import duckdb
import numpy as np

from cohortline.llm import embeddings


def test_links_equal_sql(shipped, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    rows = [(100 + i, (centres[i % 12] + rng.normal(scale=0.28, size=32)).tolist(), i % 3) for i in range(240)]
    rows += [(1000 + i, rng.normal(size=32).tolist(), None) for i in range(120)]
    rows += [(1, rows[0][1], 0), (2, rows[0][1], 0), (3, None, 1), (4, [0.0] * 32, 1), (5, [float("nan")] * 32, 1)]
    rows += [(6, [float("inf")] + [1.0] * 31, 2), (7, [None] + [1.0] * 31, 2)]
    folder = f"{tmp_path}/embeddings.parquet"
    shipped.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(folder)
    got = sorted(tuple(r) for r in embeddings.op1_embedding_near_dedup(shipped, str(tmp_path)).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/*.parquet'")
        want = sorted(con.execute(embeddings.LINKS_SQL).fetchall())
    assert got == want
    assert sum(links for _, links, _, _ in want) > 1000
    assert {row[0] for row in want if row[0] < 10 and row[1] == 0} == {3, 4, 5, 6, 7}
