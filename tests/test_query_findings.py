"""Cases of the review of the sketch engine's queries: each failed before the change that it came with."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quillmer import catalog, streaming
from quillmer.functions import hashing
from quillmer.functions.hashing import md5_60_of
from quillmer.operators import compare, find, held, sketch, tiles

DATA = "/root/testdata"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tax_report_of_a_whole_mixture(spark, sf):
    """The report over all suppliers is that of its SQL, which filters no rows."""
    sql = catalog.ORACLES["tax_report"]
    assert not re.search(r"suppkey\s*%|custkey\s*%", sql)
    with duckdb.connect() as con:
        for name in ("customer", "supplier", "region", "nation"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{sf}/{name}.parquet'")
        cursor = con.execute(sql)
        names = [x[0] for x in cursor.description]
        expected = sorted(cursor.fetchall())
    got = catalog.QUERIES["tax_report"](spark, f"{DATA}/{sf}")
    assert len(expected) > 10
    assert sorted(map(tuple, got.select(*names).collect())) == expected


def test_all_hits_of_a_passage(spark, tmp_path):
    """A passage of twelve documents has twelve hits; the best ten are among them."""
    passage = " ".join(f"{a}{b}{a}" for a in "QUILMERTS" for b in "ABCDEFGHK")
    spark.createDataFrame([(i, passage, "s1") for i in range(12)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    every, best = (catalog.QUERIES[q](spark, str(tmp_path)).collect() for q in ("find_hits_all", "find_hits"))
    assert {r["ref_idx"] for r in every} == set(range(12))
    assert len(best) == 10 and set(best) <= set(every)


def _plain_postings(rows, p):
    """(group, hash, rank, count) by hashlib, over rows (group, text)."""
    by: dict = {}
    for group, text in rows:
        text = (text or "").upper()
        for i in range(len(text) - p.kmer + 1):
            if all(c in p.alphabet for c in text[i : i + p.kmer]):
                h = int(hashlib.md5(text[i : i + p.kmer].encode()).hexdigest()[:15], 16)
                by.setdefault(group, Counter())[h] += 1
    kept = {g: sorted(x for x, n in c.items() if n >= p.min_copies)[: p.sketch_size] for g, c in by.items()}
    return {(g, x, i + 1, by[g][x]) for g, xs in kept.items() for i, x in enumerate(xs)}


@pytest.mark.parametrize("k", [*range(1, 33)])
def test_md5_in_step(k):
    data = np.random.default_rng(k).integers(0, 256, 200, dtype=np.uint8)
    at = np.array([0, 7, 100, 192 - k])
    assert md5_60_of(data, at, k).tolist() == [int(hashlib.md5(data[a : a + k].tobytes()).hexdigest()[:15], 16) for a in at]


@pytest.mark.parametrize("copies", [1, 2])
def test_groups_of_one_row_are_not_shuffled(spark, monkeypatch, copies):
    """Sketches of rows with ids of their own need no exchange; repeated and null ids, empty, null and long texts give the same as hashlib."""
    p = catalog.TEXT.with_(min_copies=copies, sketch_size=20)
    letters = catalog.LETTERS.strip()
    long = "".join(f"{a}{b}{c}{a}{c} WORD " for a in letters for b in letters for c in letters) * 2
    assert len(long) > hashing.BLOCK
    rows = [(i, f"the text of number {chr(97 + i)} " * 3) for i in range(20)] + [(30, None), (31, ""), (32, "short"), (33, long)]
    schema = "ref_idx long, seq string"
    one = sketch.postings(spark.createDataFrame(rows, schema).coalesce(1), p)
    with monkeypatch.context() as m:
        m.setattr(hashing, "spread", lambda df: df)
        assert "Exchange hash" not in sketch.postings(spark.createDataFrame(rows, schema), p)._jdf.queryExecution().toString()
    assert {tuple(r) for r in one.collect()} == _plain_postings(rows, p)
    mixed = [*rows, (5, "the text of number f again and again"), (None, "neither has an id of its own"), (None, "neither has an id either")]
    assert {tuple(r) for r in sketch.postings(spark.createDataFrame(mixed, schema), p).collect()} == _plain_postings(mixed, p)
    got = {r["ref_idx"]: (r["length"], r["hashes"]) for r in sketch.gathered(spark.createDataFrame(mixed, schema), p).collect()}
    assert set(got) == {g for g, _ in mixed} and got[30] == got[31] == got[32] == (0, [])
    assert {(g, h) for g, (_, hashes) in got.items() for h in hashes} == {(g, h) for g, h, _, _ in _plain_postings(mixed, p)}
    assert got[5][0] == sum(len(t) for g, t in mixed if g == 5)


def test_triangle_within_a_bound_joins_nothing(spark, monkeypatch):
    """Pairs that share too few hashes never become rows; those within the bound are those of brute force, over several tiles and steps."""
    p = catalog.TEXT.with_(sketch_size=20)
    rng, rows = np.random.default_rng(5), []
    for i in range(90):
        own = rng.choice(60 if i % 3 else 400, int(rng.integers(1, 21)), replace=False)
        rows.append((1000 - 7 * i, f"d{i}", i, len(own), sorted(own.tolist())))
    monkeypatch.setattr(tiles, "BLOCK_SKETCHES", 25)
    s = spark.createDataFrame(rows, "ref_idx long, name string, length long, n long, hashes array<long>")
    out = compare.triangle(s, p, max_distance=0.2, p_values=False)
    assert "Join" not in out._jdf.queryExecution().toString()
    expected = set()
    for a in rows:
        for b in rows:
            if a[0] > b[0]:
                union = sorted({*a[4], *b[4]})[:20]
                common = len({*a[4]} & {*b[4]} & {*union})
                if common and (common == len(union) or -np.log(2 * common / len(union) / (1 + common / len(union))) / p.kmer <= 0.2):
                    expected.add((a[0], b[0], a[1], b[1], common, len(union)))
    assert len(expected) > 500
    assert {(r["i"], r["j"], r["i_name"], r["j_name"], r["common"], r["denom"]) for r in out.collect()} == expected
    monkeypatch.setattr(tiles, "STEP", 200)
    table = pa.table({"ref_idx": [r[0] for r in rows], "n": [r[3] for r in rows], "hashes": pa.array([r[4] for r in rows], pa.list_(pa.int64()))})
    side = tiles._Side(table)
    got = [(side.idx[x], side.idx[y], int(c)) for i, j, _, cs in tiles.pairs_of(side, side, p, 0.2) for x, y, c in zip(i, j, cs, strict=True)]
    assert sorted((max(x, y), min(x, y), c) for x, y, c in got) == sorted((a, b, c) for a, b, _, _, c, _ in expected)


def test_held_side_is_not_shuffled(spark, monkeypatch):
    """Distances and containment against a small collection need no exchange and equal those of the joins, either side being small."""
    p = catalog.TEXT.with_(sketch_size=20)
    rng = np.random.default_rng(3)
    schema = "ref_idx long, name string, comment string, length long, n long, max_hash long, hashes array<long>, counts array<long>"

    def made(n):
        lists = [sorted(rng.choice(90, int(rng.integers(0, 21)), replace=False).tolist()) for _ in range(n)]
        return spark.createDataFrame([(100 - i, f"s{i}", "", 10 + i, len(x), x[-1] if x else None, x, x) for i, x in enumerate(lists)], schema)

    a, b = made(40), made(15)
    monkeypatch.setattr(held, "STEP", 100)
    asks = [lambda d=d: compare.dist(a, b, p, max_distance=d) for d in (1.0, 0.2)] + [lambda: compare.within(a, b, p, max_error=0.4)]
    plain = []
    with monkeypatch.context() as m:
        m.setattr(held, "HELD_SKETCHES", 0)
        plain = [Counter(map(tuple, ask().collect())) for ask in asks]
    for ask, expected in zip(asks, plain, strict=True):
        got = ask()
        assert "Exchange" not in got._jdf.queryExecution().toString()
        assert len(expected) > 20 and Counter(map(tuple, got.collect())) == expected
    with monkeypatch.context() as m:  # the references are the small side
        m.setattr(held, "HELD_SKETCHES", 20)
        got = [Counter((r["query"], r["ref"], r["common"], r["denom"]) for r in compare.dist(b, a, p, max_distance=d).collect()) for d in (1.0, 0.2)]
    assert got == [Counter((r["ref"], r["query"], r["common"], r["denom"]) for r in asks[i]().collect()) for i in (0, 1)]


def test_mixture_stream_drops_other_hashes_in_its_tasks(spark, tmp_path):
    """Of a stream only hashes of the references leave a task."""
    spark.createDataFrame([("THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG",)], "seq string").write.parquet(f"{tmp_path}/in")
    p = catalog.TEXT.with_(sketch_size=5)
    refs = sketch.sized(sketch.gathered(spark.createDataFrame([(1, "THE LAZY DOG SLEEPS")], "ref_idx long, seq string"), p).selectExpr("*", "'' name", "'' comment"))
    rows = spark.readStream.schema("seq string").parquet(f"{tmp_path}/in")
    text = streaming.mixture_stream(rows, refs, p)._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in text and "MapInArrow" in text.replace("mapinarrow", "MapInArrow")


def test_kmers_of_a_row_are_counted_where_it_is_read(spark, tmp_path):
    """No k-mer is shuffled where ids are distinct; long, null and repeated rows count as before."""
    letters = catalog.LETTERS.strip()
    long = "".join(f"{a}{b}{c}{a}{c} WORD " for a in letters for b in letters for c in letters) * 2
    rows = [(1, "The quick brown fox, the quick brown fox"), (2, None), (3, "no"), (4, long), (None, "AAAAAAAAAAAAAAAAAAAA"), (6, "six"), (7, "a seventh text of some words")]

    def expected(rows):
        by: dict = {}
        for g, t in rows:
            for x in re.findall(f"[{catalog.LETTERS}]{{12,}}", (t or "").upper()):
                by.setdefault(g, Counter()).update(x[i : i + 12] for i in range(len(x) - 11))
        return {(g, sum(c.values()), len(c), max(c.values())) for g, c in by.items()}

    for i, more in enumerate(([], [(7, "of some words of some words")])):
        spark.createDataFrame(rows + more, "doc_id long, text string").withColumn("source", F.lit("s1")).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        out = catalog.kmer_counts(spark, f"{tmp_path}/{i}")
        assert more or "Exchange hash" not in out._jdf.queryExecution().toString()
        assert {tuple(r) for r in out.collect()} == expected(rows + more)


@pytest.mark.parametrize(("window", "size"), [(1, 1), (5, 1), (7, 3), (20, 2), (20, 25)])
def test_minmers_at_positions(window, size):
    """Minmers of many rows at once are those of each row, ties, short rows and all, also at some positions only."""
    rng = np.random.default_rng(window)
    rows = [rng.integers(-m, m, n) for m in (5, 60, 1 << 62) for n in (1, window, window + 1, 90, 200)]
    h, ends = np.concatenate(rows), np.cumsum([len(x) for x in rows])
    plain = np.concatenate([find.leftmost_minmers(x, window, size) + e - len(x) for x, e in zip(rows, ends, strict=True)])
    at = np.arange(len(h))
    assert at[find.minmers_at(h, ends, at, window, size)].tolist() == plain.tolist()
    some = at[rng.random(len(h)) < 0.3]
    assert some[find.minmers_at(h, ends, some, window, size)].tolist() == sorted(set(some) & set(plain.tolist()))
