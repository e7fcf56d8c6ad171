"""Vectors, archives and the pipeline."""

import hashlib
import math

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from quillmer.llm import queries, vectors, warc

SF = "/root/testdata/sf0.001"


def near(rows, threshold):
    able = {i: np.array(v, float) for i, v in rows.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i in rows}
    for a in able:
        for b in able:
            if a != b and len(able[a]) == len(able[b]) and able[a] @ able[b] / (np.linalg.norm(able[a]) * np.linalg.norm(able[b])) >= threshold:
                links[a].add(b)
    out = {}
    for i in rows:
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


@pytest.mark.parametrize("leaf", [8192, 16])
def test_vectors(spark, monkeypatch, leaf):
    monkeypatch.setattr(vectors, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 40))
    rows = {i: (centres[i % 6] * (1 + i % 3) + rng.normal(size=40) * 0.4).astype(np.float32).tolist() for i in range(150)}
    rows |= {200: rows[3], 201: rows[3], 202: [0.0] * 40, 203: None, 204: [], 205: [float("nan")] + [1.0] * 39, 206: [None] + [1.0] * 39, 207: [float("inf")] * 40, 208: [1.0, 2.0], 209: [2.0, 4.0]}
    data = [(i, v, "a", "b") for i, v in rows.items()] + [(3, rows[3], "again", "b"), (None, rows[3], "no id", "b")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rep string, links string")
    got = vectors.near_duplicates(df).collect()
    expected = near(rows, 0.9)
    assert len(got) == len(rows) + 1
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            assert (r["n_links"], r["component_id"]) == expected[r["vec_id"]] and r["kept"] == (r["component_id"] == r["vec_id"])
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_archives(spark, tmp_path):
    long = "ü" * 600_000
    same = "x" * 1500
    rows = [(1, "http://a b\n", same), (2, None, same), (5, "u", same), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", long), (9, "u", long), (None, "u", same), (5, "u", same)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    got = sorted(warc.round_trip(df, str(tmp_path / "w")).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    assert len(got) == len(rows)
    for r in got:
        data = next((h or "") for i, _, h in rows if i == r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        to = {1: 5, 2: 5, None: 5, 8: 9}.get(r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("revisit", to) if to else ("response", None))
    chunks = [x for path in sorted(str(p) for p in (tmp_path / "w").iterdir()) for x in warc.records(path, 1000)]
    big = [c for c in chunks if c[0] == 9]
    assert [c[5] for c in big] == list(range(1200)) and b"".join(c[9] for c in big) == long.encode() and max(len(c[9]) for c in chunks) <= 1000
    assert all(c[7] == hashlib.sha1(long.encode()[: c[6]]).hexdigest() for c in big[::100])
    assert warc.round_trip(df.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert (out.columns == columns) == (name != corpus_pipeline.STAGES[-1][0])
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[5] == sizes[4]
    row = lambda d: sorted(map(tuple, d.collect()))
    assert row(corpus_pipeline.run(spark, SF)) == row(docs)


def test_pipeline_stages_take_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 30, "en", None, 150)]
    odd = spark.createDataFrame(rows, queries.table(spark, SF, "documents").schema)
    for table in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, SF).count() <= 4 * table.count()


def test_pipeline_keeps_clean_documents(spark):
    docs = queries.table(spark, SF, "documents")
    good = queries.table(spark, SF, "labels").where("quality = 1").select("doc_id")
    verdict = queries.QUERIES["op1_quality_rules"](spark, SF).join(good, "doc_id")
    assert verdict.where("not base_failed and not kept").count() == 0
    assert docs.count() > 0


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_oracle_of_archives_and_mixing(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op4_poisson_mixing", "op7_warc"):
        got = queries.QUERIES[name](spark, SF)
        expected = con.sql(queries.ORACLES[name])
        order = sorted(got.columns)
        key = lambda r: tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r)
        assert sorted(map(key, got.select(*order).collect())) == sorted(map(key, expected.select(*order).fetchall()))
