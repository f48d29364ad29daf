"""Hard-negative mining with exact integer scores from a residue number system.

Every component becomes ``floor(256 * x)``. Score matrices of cells of anchors and rows are multiplied modulo several
small primes in float32: residues lie within half a prime of 0, so sums over ``PIECE`` places stay below 2**24 and are
exact. The Chinese remainder theorem gives the signed score, as the product of the primes exceeds four times the largest
score that the longest vectors allow. Positives come from the cells of the anchor's own label; then every cell keeps the
best rows inside each positive's window, and a window over those gives the result. Anchors are a stated query set: they
meet all rows in cells of bounded size, and no pair leaves a task unless it is among the best of its cell.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; a shorter vector
counts as filled up with zeros; repeated rows are rows of their own (an anchor's copy is another row of its label), ties go
to the smaller id; a table without anchors, positives or negatives gives no row; other columns are ignored. If vectors are
so long that scores could pass 2**56 (components of 131,072 in 64 places), the call fails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.shared import stored

SCALE = 256
ANCHORS, ROWS = 4096, 4096  # of a cell
SLICE = 256  # anchors that a task scores at once
PIECE = 64  # places between two reductions
MOST_SCORE = 1 << 56  # a hundred times it still is a 64-bit number
LARGEST_PRIME = 1021  # PIECE * (LARGEST_PRIME // 2) ** 2 < 2 ** 24
MOST_LABELS = 100_000  # whose sizes are broadcast; more are joined by shuffle
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score


def moduli(largest: int) -> list[int]:
    """Primes from ``LARGEST_PRIME`` down whose product exceeds four times the largest absolute score."""
    out, product, n = [], 1, LARGEST_PRIME
    while product <= 4 * largest:
        if all(n % d for d in range(2, int(n**0.5) + 1)):
            out.append(n)
            product *= n
        n -= 1
    return out


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo p for integer matrices, by float32 products."""

    def part(x: np.ndarray) -> np.ndarray:
        r = np.remainder(x, p)
        return np.where(r > p // 2, r - p, r).astype(np.float32)

    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(0, a.shape[1], PIECE):
        out = np.remainder(out + (part(a[:, k : k + PIECE]) @ part(b[:, k : k + PIECE]).T).astype(np.int32), p)
    return out


def exact_scores(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """All inner products of two integer matrices, from their residues.

    Scores are below a quarter of the product of all primes, so the last digit of the mixed-radix form tells their sign.
    Only the last step may pass 2**63; it wraps, and so does taking the product away.
    """
    x, product = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes:
        digit = np.remainder((residue_product(a, b, p) - np.remainder(x, p)) * pow(product, -1, p), p)
        x += product * digit
        product *= p
    wrapped = (product + (1 << 63)) % (1 << 64) - (1 << 63)
    return np.where(2 * digit > p, x - np.int64(wrapped), x)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of integer lists as a matrix, short rows filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _best(scores: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n largest allowed scores of each row, equal ones from the left."""
    worst = np.iinfo(np.int64).min
    left = np.where(allowed, scores, worst)
    at = np.arange(len(left))
    rows, columns = [], []
    for _ in range(min(n, left.shape[1])):
        best = left.argmax(axis=1)
        live = left[at, best] > worst
        if not live.any():
            break
        rows.append(at[live])
        columns.append(best[live])
        left[at, best] = worst
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns])


def prepared(vectors: DataFrame, key: str = "vec_id", label: str = "label", vec: str = "embedding") -> DataFrame:
    """(row, id, label, q) of the rows that take part, stored; ``row`` tells repeated rows apart."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vec).isNotNull() & whole)
    q = F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE))
    return stored(kept.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), q.alias("q")), "vectors")


def _cells(rows: DataFrame, mine: Column, other: Column, name: str, other_name: str) -> DataFrame:
    """Every row in its own cell, once for each cell of the other side."""
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), mine).cast("int")).withColumn(other_name, F.explode(F.sequence(F.lit(0), (other - 1).cast("int"))))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for prepared rows.

    ``anchor`` says which rows are anchors. An anchor's positives are its best other rows of its label; a positive's
    negatives are the best rows of other labels whose score is between ``low`` and ``high`` percent of the positive's.
    """
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n_rows, n_anchors, width, longest = rows.agg(F.count("*"), F.count_if(anchor), F.max(F.size("q")), F.max(square)).first()
    longest = int((longest or 0.0) * (1 + 1e-9)) + 1
    if longest > MOST_SCORE:
        raise ValueError("scores could pass 2**56: scale the vectors down")
    primes, width = moduli(longest), width or 0
    asked = rows.where(anchor)
    per = lambda n, size: F.ceil(n / size)

    def like(table: pa.Table) -> pa.Table:
        """The best rows of the anchors' label in one cell."""
        table = table.sort_by([("id", "ascending"), ("row", "ascending")])
        is_anchor = table["anchor"].to_numpy(zero_copy_only=False)
        a, b = table.filter(pa.array(is_anchor)), table.filter(pa.array(~is_anchor))
        x, y = _matrix(a["q"], width), _matrix(b["q"], width)
        a_row, a_id, b_row, b_id = (t[c].to_numpy() for t, c in ((a, "row"), (a, "id"), (b, "row"), (b, "id")))
        out = []
        for s in range(0, len(x), SLICE):
            scores = exact_scores(x[s : s + SLICE], y, primes)
            r, c = _best(scores, a_row[s : s + SLICE, None] != b_row[None, :], positives)
            out.append(pa.table({"row": a_row[s + r], "id": a_id[s + r], "positive_row": b_row[c], "positive_id": b_id[c], "positive_score": scores[r, c]}))
        return pa.concat_tables(out) if out else none_like

    none_like = pa.table({c: pa.array([], pa.int64()) for c in ("row", "id", "positive_row", "positive_id", "positive_score")})
    sizes = stored(rows.groupBy("label").agg(per(F.count("*"), ROWS).alias("n_cells"), per(F.count_if(anchor), ANCHORS).alias("n_anchor_cells")).where("n_anchor_cells > 0"), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_LABELS else sizes.hint("merge")
    left = _cells(asked.join(sizes, "label"), F.col("n_anchor_cells"), F.col("n_cells"), "i", "j").withColumn("anchor", F.lit(True))
    right = _cells(rows.join(sizes, "label"), F.col("n_cells"), F.col("n_anchor_cells"), "j", "i").withColumn("anchor", F.lit(False))
    columns = ["label", "i", "j", "row", "id", "q", "anchor"]
    long = ", ".join(f"{c} long" for c in none_like.column_names)
    near = left.select(columns).unionAll(right.select(columns)).groupBy("label", "i", "j").applyInArrow(like, long)
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    best = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    windows = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("r", "positive_id", "positive_score"))).alias("positives"))
    anchors = stored(asked.join(windows.hint("merge"), "row"), "anchors")

    def unlike(table: pa.Table) -> pa.Table:
        """The best rows of other labels inside each positive's window, in one cell."""
        table = table.sort_by([("id", "ascending"), ("row", "ascending")])
        is_anchor = table["positives"].is_valid().to_numpy(zero_copy_only=False)
        a, b = table.filter(pa.array(is_anchor)), table.filter(pa.array(~is_anchor))
        x, y = _matrix(a["q"], width), _matrix(b["q"], width)
        a_row, a_id, a_label, b_id, b_label = (t[c].to_numpy() for t, c in ((a, "row"), (a, "id"), (a, "label"), (b, "id"), (b, "label")))
        lists = a["positives"].combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        first = np.cumsum(n) - n
        fields = lists.flatten()
        p_id, p_score, p_no = (fields.field(i).to_numpy() for i in (1, 2, 0))
        out = []
        for s in range(0, len(x), SLICE):
            scores = exact_scores(x[s : s + SLICE], y, primes)
            unequal = a_label[s : s + SLICE, None] != b_label[None, :]
            for k in range(positives):
                mine = np.flatnonzero(n[s : s + SLICE] > k)
                at = first[s + mine] + k
                here, want = scores[mine], p_score[at][:, None]
                r, c = _best(here, unequal[mine] & (low * want <= 100 * here) & (100 * here <= high * want), negatives)
                out.append(
                    pa.table(
                        {"row": a_row[s + mine[r]], "no": p_no[at[r]].astype(np.int64), "anchor_id": a_id[s + mine[r]], "positive_id": p_id[at[r]], "positive_score": p_score[at[r]], "negative_id": b_id[c], "negative_score": here[r, c]}
                    )
                )
        return pa.concat_tables(out) if out else none_unlike

    none_unlike = pa.table({c: pa.array([], pa.int64()) for c in ("row", "no", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")})
    n_cells, n_anchor_cells = F.lit(max(1, -(-n_rows // ROWS))), F.lit(max(1, -(-n_anchors // ANCHORS)))
    left = _cells(anchors, n_anchor_cells, n_cells, "i", "j")
    right = _cells(rows, n_cells, n_anchor_cells, "j", "i").withColumn("positives", F.lit(None).cast(dict(anchors.dtypes)["positives"]))
    columns = ["i", "j", "row", "id", "label", "q", "positives"]
    long = ", ".join(f"{c} long" for c in none_unlike.column_names)
    found = left.select(columns).unionAll(right.select(columns)).groupBy("i", "j").applyInArrow(unlike, long)
    rank = F.row_number().over(Window.partitionBy("row", "no").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label = e.label as alike, e.vec_id as id, list_dot_product(a.q, e.q)::bigint as score
  from e a join e on e.vec_id <> a.vec_id where a.vec_id % 50 = 0),
p as (
  select anchor_id, id as positive_id, score as positive_score from s where alike
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (
  select p.anchor_id, positive_id, positive_score, s.id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and not alike and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


def mined(vectors: DataFrame) -> DataFrame:
    """The registered query: every 50th id is an anchor, every 7th id counts under the next label."""
    rows = prepared(vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")))
    return hard_negatives(rows, F.col("id") % 50 == 0)
