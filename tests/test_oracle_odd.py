"""Queries against their oracles on odd rows: copies and chains of vectors, letters beyond ASCII at the ends of words."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from foliant.plans import entity_queries, registry  # noqa: F401
from tests.test_oracle import canonical

TEXTS = [
    "Heitüit Ensch Ensch Ensch ist Leadé Officer Büroüit hier",
    "Seen éAnna Maria Smith and Karl Anna Mariaé there, Mit Smith² too and Dr. Anna Mariaé.",
    "Only 5 poundé or 7 pounds, $5 mü and $6 m, Summit Marine Coé and Summit Marine Co here.",
    "       Anna Maria     ",
    "Jean Paul Kühn, CEO of the Company, Chief Fooé Officer, Senior élan, üexample.com Anna Maria Smith",
    "",
    None,
]


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    docs = [(i, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(at / "documents.parquet")
    pd.read_parquet(f"{sf}/orders.parquet").head(20).to_parquet(at / "orders.parquet")
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = lambda b, s: base[b] + rng.normal(size=64) * s / 8
    rows = [base[0]] * 4 + [near(1, 0.3) for _ in range(6)] + [near(2, 0.5) for _ in range(12)] + [base[3] * (1 - k / 6) + base[4] * k / 6 for k in range(7)] + [base[5]]
    label = [0] * 4 + [0] * 6 + [1, 0] * 6 + [1] * 7 + [3]
    pd.DataFrame({"vec_id": range(len(rows)), "embedding": [r.astype(np.float32) for r in rows], "label": label}).to_parquet(at / "embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["cluster_entities", "merge_clusters", "resolve_entities", "resolution_stats", "extract_people", "people_linkage_columns", "extract_rich_entities", "money_mentions"])
def test_odd_rows(spark, odd, name):
    con = duckdb.connect()
    for t in ("documents", "orders", "embeddings"):
        con.sql(f"create view {t} as select * from '{odd}/{t}.parquet'")
    a, b = canonical(registry.QUERIES[name](spark, odd).toPandas()), canonical(con.sql(registry.ORACLES[name]).df())
    assert len(a)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
