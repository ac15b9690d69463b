"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, scored as sparse dot products.

``fit`` learns from at most ``max_rows`` labelled rows (those of smallest id hash), which one task streams in hash order; everything
else reads all rows. The weights (2**BITS doubles and one bias) go to the scoring tasks.

Defined results: a null text counts as empty and gets the score of the bias alone; rows without a label, or whose label is null or
neither 0 nor 1, teach nothing; several labels of one id count each. With no labelled row at all every score is 0.5. Repeated rows and
rows without id are scored like any other. Other columns pass through ``score`` untouched.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evalspark.llm import hashedmodel as H

MAX_ROWS = 12_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, label, turn): the texts of the ``max_rows`` labelled ids of smallest hash; ids are chosen before texts are read."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = ids.select("*", F.xxhash64("doc_id").alias("turn")).orderBy("turn", "label").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "turn")  # at most max_rows small rows


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights of the cells, then the bias."""
    def featured(batches):
        for b in batches:
            for at, part in slices(b.column(0)):
                cell, value, rows = H.frequencies(*H.style_groups(part))
                yield pa.RecordBatch.from_arrays([
                    b.column(2).slice(at, len(part)), b.column(1).slice(at, len(part)),
                    pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(cell, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(value, pa.float32()))], ["turn", "label", "cell", "value"])

    def learned(batches):
        model = H.Ftrl((1 << H.BITS) + 1)
        bias = np.array([1 << H.BITS])
        for b in batches:
            label, cells, values = b.column(1), b.column(2), b.column(3)
            for r in range(len(b)):
                model.learn(np.concatenate([cells[r].values.to_numpy(), bias]), np.concatenate([values[r].values.to_numpy(), [1.0]]), float(label[r].as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float64).tobytes()])], ["w"])
    rows = training_rows(docs, labels, label, max_rows).mapInArrow(featured, "turn bigint, label int, cell array<int>, value array<float>")
    row = rows.repartition(1).sortWithinPartitions("turn", "label").mapInArrow(learned, "w binary").first()
    if row is None:  # a plan known to be empty runs no task at all
        return np.zeros((1 << H.BITS) + 1)
    return np.frombuffer(bytes(row["w"]), np.float64)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of scores between 0 and 1."""
    spread = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches):
        w = spread.value
        for b in batches:
            scores = np.zeros(len(b))
            text = b.column(b.schema.get_field_index(text_col))
            for at, part in slices(text):
                scores[at:at + len(part)] = H.sigmoid(H.frequency_dots(*H.style_groups(part), w) + w[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], [*b.schema.names, out])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def slices(text: pa.Array, limit: int = 1 << 20):
    """(first row, slice) with about ``limit`` bytes each, one row at least."""
    _, offs = H.T.utf8(text)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield at, text.slice(at, to - at)
        at = to
