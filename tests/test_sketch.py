"""Parameters, k-mers, hashes and sketches against hand-made values and plain Python."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmer.functions import kmers
from quillmer.functions.hashing import KmerHasher, hashed, murmur3_low64, unsigned
from quillmer.functions.kmers import COMPLEMENTS
from quillmer.operators import compare, info, sketch
from quillmer.params import SketchParams, parse_size
from quillmer.sources import sequences

A = "ACGTACGTGACCTTGANNacgtttgacaTTACGGATCCA"
B = "ACGTACGTGACCTTGAACGTTTGACATTACGGTTCCAGG"
P5 = SketchParams(kmer=5, sketch_size=8, counts=True)


def plain_kmers(text, p):
    text = text if p.preserve_case else "".join(c.upper() if "a" <= c <= "z" else c for c in text)
    table = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", COMPLEMENTS, strict=True))
    for i in range(len(text) - p.kmer + 1):
        w = text[i : i + p.kmer]
        if set(w) <= set(p.alphabet):
            yield min(w, "".join(table[c] for c in reversed(w))) if p.canonical else w


def plain_hash(kmer, p):
    data = np.frombuffer(kmer.encode() + b"\0" * 8, np.uint8)
    h = int(murmur3_low64(data, np.zeros(1, np.int64), len(kmer), p.seed)[0])
    return h & 0xFFFFFFFF if p.hash_bits == 32 else h


@pytest.mark.parametrize(
    ("kmer", "seed", "expected"),
    [
        ("ACG", 42, 1731421407650554201), ("ACGTACGTA", 42, 3684529260574405972), ("ACGTACGTACGTACGTA", 42, 9520599998506090000), ("A" * 21, 42, 18154334747705351023),
        ("ACGTTGCATGTCGCATGATGC", 42, 5378881876095216746), ("ACG", 0, 15101553637654275741), ("ACGTACGTA", 0, 9708527796277382336), ("A" * 21, 0, 10272572411251375724),
    ],
)
def test_murmur_vectors(kmer, seed, expected):
    data = np.frombuffer(kmer.encode() + b"\0" * 8, np.uint8)
    assert int(murmur3_low64(data, np.zeros(1, np.int64), len(kmer), seed)[0]) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACGTNacgt*", max_size=60), max_size=5), st.sampled_from([3, 5, 11, 16, 17, 32]), st.booleans())
def test_hasher_is_the_definition(seqs, k, canonical):
    p = SketchParams(kmer=k, canonical=canonical)
    got = {}
    for row, h in KmerHasher(p).each([s.encode() for s in seqs]):
        got.setdefault(row, []).extend(h.tolist())
    for row, s in enumerate(seqs):
        flip = 1 << 63 if p.hash_bits == 64 else 0
        assert got.get(row, []) == [plain_hash(x, p) - flip for x in plain_kmers(s, p)]


def test_long_sequences_are_hashed_block_by_block(monkeypatch):
    from quillmer.functions import hashing

    p, seq = SketchParams(kmer=5), ("ACGTTGCAN" * 40).encode()
    whole = np.concatenate([h for _, h in KmerHasher(p).each([seq])])
    monkeypatch.setattr(hashing, "BLOCK", 32)
    assert np.concatenate([h for _, h in KmerHasher(p).each([seq])]).tolist() == whole.tolist()


def postings(spark, rows, p):
    out = sketch.postings(spark.createDataFrame(rows, "ref_idx long, seq string"), p)
    got = {}
    for r in out.orderBy("ref_idx", "rank").collect():
        got.setdefault(r["ref_idx"], []).append((r["hash"], r["count"]))
    return got


def test_hand_made_sketches(spark):
    got = postings(spark, [(0, A), (1, B)], P5)
    assert got[0] == [(229084878, 1), (251270250, 1), (522828271, 2), (590127142, 1), (642617826, 1), (931493783, 1), (1140567069, 1), (1178735431, 1)]
    assert got[1] == [(206079662, 1), (229084878, 1), (251270250, 1), (522828271, 2), (590127142, 1), (642617826, 1), (767653866, 1), (801453816, 1)]
    got = postings(spark, [(0, A), (1, B)], P5.with_(min_copies=2))
    assert got[0] == [(522828271, 2), (1657781974, 2), (3081465792, 2)]
    assert got[1] == [(522828271, 2), (1178735431, 2), (1657781974, 2)]
    got = postings(spark, [(0, A)], P5.with_(canonical=False))
    assert [h for h, _ in got[0]] == [2355910, 377950504, 522828271, 559215256, 664004243, 743244184, 1043150399, 1139773920]


def test_pair_of_hand_made_sketches(spark):
    rows = spark.createDataFrame([(0, 0, 0, "A", "", A), (1, 1, 0, "B", "", B)], "file_idx int, f int, rec_no long, file string, comment string, seq string").withColumn("name", F.col("file"))
    for size, common, denom, distance, p_value in ((8, 5, 8, 0.0524728528934982, 1.217472699254901e-07), (1000, 22, 36, 0.05525067532563162, 2.7774717015219497e-29)):
        p = P5.with_(sketch_size=size)
        s = sketch.sketch(rows, p).persist()
        r = compare.triangle(s, p).collect()[0]
        assert (r["common"], r["denom"]) == (common, denom)
        assert r["distance"] == pytest.approx(distance, rel=1e-12)
        assert r["p_value"] == pytest.approx(p_value, rel=1e-9)


def test_hashes_above_the_sign_bit_sort_as_unsigned(spark):
    p = SketchParams(kmer=17, sketch_size=50, counts=True)
    text = "".join("ACGT"[i * i * 7 % 11 % 4] for i in range(300))
    got = sketch.postings(spark.createDataFrame([(0, text)], "ref_idx long, seq string"), p).orderBy("rank").select(unsigned(F.col("hash"), p).cast("string").alias("h")).collect()
    expected = sorted({plain_hash(x, p) for x in plain_kmers(text, p)})[:50]
    assert [int(r["h"]) for r in got] == expected


def test_merging_and_cutting_sketches(spark):
    p = SketchParams(kmer=7, sketch_size=20, counts=True)
    text = "".join("ACGT"[(i * i + i // 3) % 4] for i in range(200))
    whole = postings(spark, [(0, text[:120]), (0, text[120:])], p)[0]
    parts = [sketch.postings(spark.createDataFrame([(0, t)], "ref_idx long, seq string"), p) for t in (text[:120], text[120:])]
    merged = sketch.merged(parts, p).orderBy("rank").collect()
    assert [(r["hash"], r["count"]) for r in merged] == whole
    assert postings(spark, [(0, text[:120]), (0, text[120:])], p.with_(sketch_size=9))[0] == whole[:9]


def test_both_hash_functions_count_alike(spark):
    df = spark.createDataFrame([(0, A), (1, B), (1, A), (2, None), (3, "AC")], "ref_idx long, seq string")
    totals = [{r["ref_idx"]: (r["n"], r["c"]) for r in hashed(df, "ref_idx", "seq", P5.with_(hash_fn=f)).groupBy("ref_idx", "hash").agg(F.sum("count").alias("c")).groupBy("ref_idx").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()} for f in ("murmur3", "md5_60")]
    assert totals[0] == totals[1]
    assert totals[0][0] == (26, 29)


def test_reverse_complement_and_translation(spark):
    row = spark.createDataFrame([("ACGTUNRYX", "ATGGCCTAANTG")], "a string, b string").select(kmers.reverse_complement(F.col("a")).alias("a"), kmers.frames(F.col("b")).alias("b")).first()
    assert row["a"] == "NRYNAACGT"
    assert row["b"][0] == "MA**"
    assert row["b"][1] == "WPK"[:2] + "*" or len(row["b"][1]) == 3
    assert len(row["b"]) == 6


def test_sizes_and_rules():
    assert parse_size("10k") == 10_000 and parse_size("2M") == 2_000_000 and parse_size("7") == 7
    for bad in ("4.6M", "x", "", "5q"):
        with pytest.raises(ValueError):
            parse_size(bad)
    assert SketchParams.of(protein=True).kmer == 9 and not SketchParams.of(protein=True).canonical
    assert SketchParams.of(min_copies=2).reads and SketchParams.of(genome_size="5m").counts
    assert SketchParams(kmer=16).hash_bits == 32 and SketchParams(kmer=17).hash_bits == 64
    for wrong in ({"kmer": 33}, {"sketch_size": 0}, {"reads": True, "concatenated": False}, {"hash_fn": "x"}):
        with pytest.raises(ValueError):
            SketchParams(**wrong)
    with pytest.raises(ValueError):
        SketchParams.of(memory_bound="1g", min_copies=3)


def test_compatibility():
    base = SketchParams()
    assert base.accepts(SketchParams(kmer=20)) and base.accepts(SketchParams(seed=1)) and base.accepts(SketchParams(canonical=False))
    assert base.accepts(SketchParams(sketch_size=10)) and not base.accepts(SketchParams(sketch_size=10), allow_smaller=True)
    with pytest.warns(UserWarning):
        assert base.accepts(SketchParams(sketch_size=5000)) is None


def test_comments_lengths_and_modes(spark):
    rows = [("f1", 0, 0, "a", "first one", "AC"), ("f1", 0, 1, "b", "second", A), ("f1", 0, 2, "c", "", B), ("f2", 1, 0, "d", "only", B)]
    records = spark.createDataFrame(rows, "file string, file_idx int, rec_no long, name string, comment string, seq string")
    got = {r["name"]: r for r in sketch.sketch(records, P5).collect()}
    assert got["f1"]["comment"] == "[2 seqs] b second [...]" and got["f1"]["length"] == len(A) + len(B)
    assert got["f2"]["comment"] == "d only"
    each = sketch.sketch(records, P5.with_(concatenated=False)).orderBy("ref_idx").collect()
    assert [(r["name"], r["length"]) for r in each] == [("b", len(A)), ("c", len(B)), ("d", len(B))]
    reads = SketchParams.of(kmer=5, sketch_size=8, reads=True)
    one = sketch.sketch(records, reads).collect()
    assert len(one) == 1 and one[0]["comment"].startswith("[3 seqs] b second")
    assert one[0]["length"] == int(2**32 * one[0]["n"] / one[0]["max_hash"])
    assert sketch.sketch(records, SketchParams.of(kmer=5, genome_size="5k")).first()["length"] == 5000
    stop = sketch.sketch(records, SketchParams.of(kmer=5, sketch_size=8, target_coverage=1.0)).first()
    assert stop["comment"] == "b second"


def test_info(spark):
    s = sketch.sketch(spark.createDataFrame([("f", 0, 0, "a", "x", A)], "file string, file_idx int, rec_no long, name string, comment string, seq string"), P5).persist()
    assert {(r["bin"], r["frequency"]) for r in info.histogram(s).collect()} == {(1, 7), (2, 1)}
    import json

    dump = json.loads(info.dump(s, P5))
    assert dump["sketches"][0]["hashes"][0] == 229084878 and dump["hashBits"] == 32 and dump["sketches"][0]["counts"][2] == 2
    assert info.header(P5, 1)["kmer"] == 5
    named = sketch.renamed(s, "new", "other").first()
    assert (named["name"], named["comment"]) == ("new", "other")


def test_text_tables_as_sequences(spark):
    df = spark.createDataFrame([(1, "x", "ACGT"), (2, "x", "AAAA"), (3, "y", None)], "id long, g string, t string")
    got = sequences.from_table(df, "t", file="g", name="id", order="id").orderBy("file_idx", "rec_no").collect()
    assert [(r["file"], r["file_idx"], r["rec_no"], r["name"]) for r in got] == [("x", 0, 0, "1"), ("x", 0, 1, "2"), ("y", 1, 0, "3")]
