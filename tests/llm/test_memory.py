"""What tasks hold at a time: texts go to Python in batches of bounded bytes."""

from __future__ import annotations

import uuid

import pyarrow as pa

import corpus_pipeline
import panelcast.llm.ngram_join as nj
import panelcast.llm.suffix_dedup as dedup
from panelcast.llm.tables import BATCH_BYTES, BATCH_LIMIT


def noted(kernel, folder):
    """The kernel; each batch it gets leaves a file named by its bytes and rows."""
    def run(batches):
        def noting():
            for batch in batches:
                (folder / f"{batch.nbytes}-{batch.num_rows}-{uuid.uuid4().hex}").touch()
                yield batch
        return kernel(noting())
    return run


def sizes(folder):
    return [tuple(map(int, p.name.split("-")[:2])) for p in folder.iterdir()]


def long_texts(spark, rows=3000):
    """12 MB of texts in one partition, fewer than Spark's 10,000 rows of a batch."""
    return spark.range(0, rows, 1, 1).selectExpr(
        "id AS doc_id", "concat_ws(' ', transform(sequence(1, 500), k -> concat('w', (id * 1009 + k * k) % 9973))) AS text",
        "'en' AS lang", "'s' AS source", "3000L AS n_chars")


def test_join_reads_texts_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nj, "_measure", noted(nj._measure, tmp_path))
    spark.conf.unset(BATCH_LIMIT)
    before = spark.conf.get(BATCH_LIMIT, None)
    groups = nj.similar_groups(long_texts(spark))
    assert spark.conf.get(BATCH_LIMIT, None) == before
    assert groups.count() == 3000
    got = sizes(tmp_path)
    assert sum(rows for _, rows in got) == 3000 and max(size for size, _ in got) < 2 * BATCH_BYTES


def test_pipeline_stages_read_texts_in_small_batches(spark, tmp_path):
    spark.conf.unset(BATCH_LIMIT)
    docs = long_texts(spark)
    try:
        corpus_pipeline.benchmark_passages(spark, docs, "/root/testdata/sf0.001")
        docs.select("text").mapInArrow(noted(lambda batches: batches, tmp_path), "text string").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset(BATCH_LIMIT)
    assert max(size for size, _ in sizes(tmp_path)) < 2 * BATCH_BYTES


def test_signatures_travel_as_one_column(spark, monkeypatch):
    """Code that copies a column for each word of a signature took the executors' compiler 440 MB."""
    found = []
    probes = nj._Join.probes
    monkeypatch.setattr(nj._Join, "probes", lambda self, rows: found.append(probes(self, rows)) or found[-1])
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[a : a + 90]) for a in range(0, 100, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in nj.similar_groups(docs).collect()}
    assert set(groups.values()) == {0}
    assert found and all(len(signs.columns) <= 3 for _, signs in found)


def test_chunks_are_taken_of_small_stretches(monkeypatch):
    """A task holds some 100 bytes for each byte that it takes apart at a time."""
    seen, chunks = [], dedup.chunks
    monkeypatch.setattr(dedup, "chunks", lambda data, *a: seen.append(len(data)) or chunks(data, *a))
    texts = [f"{k} " * 1500 for k in range(2000)] + ["".join(f"{k} " for k in range(700_000))]
    batch = pa.RecordBatch.from_pydict({"text": texts, "text_key": list(range(len(texts)))})
    covered = [0] * len(texts)
    for part in dedup._candidates(400, 96)(iter([batch])):
        for key, low, high in zip(*(part.column(c).to_pylist() for c in ("text_key", "low", "high"))):
            covered[key] += high - low
    assert covered == [len(t) - 399 for t in texts]
    assert max(seen) < (1 << 20) + 400
