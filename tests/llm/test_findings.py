"""Cases of the review: each failed before the change that it came with."""

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import corpus_pipeline

from quillmer.llm import queries

DATA = "/root/testdata"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_quality_verdicts_at_every_size(spark, tmp_path, sf):
    """Held-out good documents are kept and labelled bad ones rejected, whatever the table's size."""
    labels = pq.read_table(f"{DATA}/{sf}/labels.parquet")
    ids, good = labels["doc_id"].to_pylist(), labels["quality"].to_pylist()
    held = {i for i, q in zip(ids, good) if q == 1 and i * 7919 % 5 == 0}
    bad = {i for i, q in zip(ids, good) if q == 0}
    pq.write_table(labels.filter(pc.invert(pc.is_in(labels["doc_id"], pa.array(sorted(held))))), tmp_path / "labels.parquet")
    (tmp_path / "documents.parquet").symlink_to(f"{DATA}/{sf}/documents.parquet")
    rows = queries.op1_quality_rules(spark, str(tmp_path)).where("not base_failed").select("doc_id", "kept").collect()
    kept_good = [r["kept"] for r in rows if r["doc_id"] in held]
    kept_bad = [r["kept"] for r in rows if r["doc_id"] in bad]
    print(sf, "held-out good kept", sum(kept_good), len(kept_good), "bad kept", sum(kept_bad), len(kept_bad))
    assert sum(kept_good) >= 0.9 * len(kept_good)
    assert sum(kept_bad) <= max(1, 0.02 * len(kept_bad))


def test_pipeline_keeps_the_other_text_of_a_repeated_id(spark):
    """A text without a copy stays, even if another row of its id is a copy of a smaller id."""
    copied, alone = " ".join(f"copied{i}" for i in range(60)), " ".join(f"alone{i}" for i in range(60))
    rows = [(1, copied, "a"), (2, copied, "b"), (2, alone, "c"), (3, None, "d"), (None, copied, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    left = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(r["fingerprint"] for r in left.collect()) == ["a", "c", "d", "e"]
