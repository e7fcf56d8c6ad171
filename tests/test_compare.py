"""Statistics, comparison, screening, taxonomy, find, files and streams."""

import gzip
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmer import catalog, streaming
from quillmer.functions import stats
from quillmer.operators import compare, find, screen, sketch, taxonomy
from quillmer.params import SketchParams
from quillmer.sources import dumps, formats, sequences, store

P = SketchParams(kmer=7, sketch_size=30, counts=True)


def exact_tail(x, n, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(x, n + 1))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 400), st.integers(0, 400), st.floats(1e-9, 0.999))
def test_binomial_tail(n, x, p):
    got = float(stats.binomial_tail(np.array([x]), np.array([n]), np.array([p]))[0])
    expected = 1.0 if x <= 0 else 0.0 if x > n else exact_tail(x, n, p)
    assert got == pytest.approx(expected, rel=1e-8, abs=1e-290)


def test_published_p_values():
    k, size = 4.0**21, 502359
    for length, common, expected in ((4639675, 41, 4.48626e-214), (5498450, 35, 2.61074e-180), (4631469, 41, 4.45454e-214)):
        pa, pb = 1 / (1 + k / length), 1 / (1 + k / size)
        got = stats.binomial_tail(np.array([common]), np.array([1000]), np.array([pa * pb / (pa + pb - pa * pb)]))[0]
        assert float(f"{got:.6g}") == pytest.approx(expected, rel=2e-6)
    for shared, expected in ((44, 5.00742e-229), (36, 1.7048e-184)):
        got = stats.binomial_tail(np.array([shared]), np.array([1000]), np.array([size / k]))[0]
        assert float(f"{got:.6g}") == pytest.approx(expected, rel=2e-6)


def test_published_distances_and_identities(spark):
    df = spark.createDataFrame([(41, 1000), (35, 1000), (456, 1000), (0, 1000), (5, 5), (0, 0)], "c long, d long")
    got = [r[0] for r in df.select(stats.distance(F.col("c"), F.col("d"), 21)).collect()]
    assert [float(f"{x:.6g}") for x in got] == [0.12101, 0.12827, 0.0222766, 1.0, 0.0, 0.0]
    got = spark.createDataFrame([(44, 1000), (36, 1000), (0, 3), (3, 3)], "c long, d long").select(stats.identity(F.col("c"), F.col("d"), 21)).collect()
    assert [float(f"{r[0]:.6g}") for r in got] == [0.861792, 0.853596, 0.0, 1.0]


def test_bounds(spark):
    got = {(r["mode"], r["sketch_size"], r["distance"]): r["bound"] for r in stats.bounds(spark).collect()}
    assert len(got) == 144
    for (mode, s, d), expected in {("distance", 100, 0.05): 0.0270708, ("screen", 100, 0.05): 0.0195634, ("screen", 100, 0.2): 0.8, ("distance", 1000, 0.2): 0.0630219, ("distance", 10000, 0.05): 0.00199888, ("screen", 10000, 0.2): 0.0109799}.items():
        assert float(f"{got[mode, s, d]:.6g}") == expected
    assert got["distance", 100, 0.2] == math.inf


def texts(n=8, size=150):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("ACGT"), size))
    out = []
    for i in range(n):
        letters = list(base if i % 3 else "".join(rng.choice(list("ACGT"), size)))
        for j in rng.integers(0, size, 2 * i):
            letters[j] = "ACGT"[int(rng.integers(4))]
        out.append("".join(letters))
    return [*out, "", "ACG"]


def sketched(spark, seqs, p=P):
    return catalog.sketches(spark.createDataFrame(list(enumerate(seqs)), "ref_idx long, seq string"), p)


def test_distances_by_the_definition(spark):
    s = sketched(spark, texts())
    hashes = {r["ref_idx"]: r["hashes"] for r in s.collect()}
    got = {(r["ref"], r["query"]): r for r in compare.dist(s, s, P).collect()}
    assert len(got) == len(hashes) ** 2
    for (a, b), r in got.items():
        union = sorted({*hashes[a], *hashes[b]})[: P.sketch_size]
        common = len({*union} & {*hashes[a]} & {*hashes[b]})
        assert (r["common"], r["denom"]) == (common, len(union))
        assert r["distance"] == pytest.approx(got[b, a]["distance"])
    edges = {(r["i"], r["j"]): r["distance"] for r in compare.triangle(s, P).collect()}
    assert set(edges) == {(i, j) for i in hashes for j in hashes if i > j}
    assert all(d == pytest.approx(got[i, j]["distance"]) for (i, j), d in edges.items())
    near = {(r["ref"], r["query"]) for r in compare.dist(s, s, P, max_distance=0.3).collect()}
    assert near == {k for k, r in got.items() if r["distance"] <= 0.3 and r["common"]}
    lines = [r["value"] for r in formats.triangle_lines(compare.triangle_rows(compare.triangle(s, P), s)).collect()]
    assert lines[0] == f"\t{len(hashes)}" and len(lines) == len(hashes) + 1
    table = compare.dist_table(compare.dist(s, s, P), s)
    assert table.count() == len(hashes) and len(table.columns) == len(hashes) + 2


def test_containment_by_the_definition(spark):
    s = sketched(spark, texts())
    rows = {r["ref_idx"]: r["hashes"] for r in s.collect()}
    got = {(r["ref"], r["query"]): (r["score"], r["error"]) for r in compare.within(s, s, P, max_error=1.0).collect()}
    for a, ra in rows.items():
        for b, rb in rows.items():
            j = min(len(ra), len(rb), sum(x <= ra[-1] for x in rb)) if ra and rb else 0
            if j:
                assert got[a, b] == (pytest.approx(len({*rb[:j]} & {*ra}) / j), pytest.approx(1 / math.sqrt(j)))
            else:
                assert (a, b) not in got


@pytest.mark.parametrize("winner", [False, True])
def test_screen_by_the_definition(spark, winner):
    seqs = texts()
    s = sketched(spark, seqs)
    mixture = [seqs[1], seqs[2][:80], seqs[4], "NNNN", None]
    df = spark.createDataFrame([(x,) for x in mixture], "seq string")
    counts = {r["hash"]: r["count"] for r in screen.mixture_counts(df, P).collect()}
    refs = {r["ref_idx"]: r for r in s.collect()}
    depth = {i: sorted(counts[h] for h in r["hashes"] if h in counts) for i, r in refs.items()}
    if winner:
        rank = {i: (-(len(depth[i]) / r["n"]) if r["n"] else 0, -r["length"], i) for i, r in refs.items()}
        own = {i: [] for i in refs}
        for h, c in counts.items():
            if holders := [i for i, r in refs.items() if h in r["hashes"]]:
                own[min(holders, key=rank.get)].append(c)
        depth = {i: sorted(x) for i, x in own.items()}
    got = {r["ref_idx"]: r for r in screen.screen(s, df, P, winner_takes_all=winner).collect()}
    assert set(got) == {i for i, x in depth.items() if x}
    for i, r in got.items():
        assert (r["shared"], r["median_multiplicity"]) == (len(depth[i]), depth[i][len(depth[i]) // 2])
    every = screen.screen(s, df, P, winner_takes_all=winner, min_identity=-1).count()
    assert every == len(refs)
    lines = [r["value"] for r in formats.screen_lines(screen.screen(s, df, P, winner_takes_all=winner)).collect()]
    assert len(lines) == len(got) and all(line.count("\t") == 5 for line in lines)


def test_taxonomy(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n3\t|\t2\t|\tspecies\t|\n4\t|\t2\t|\tspecies\t|\n9\t|\t77\t|\tlost\t|\n")
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tG\t|\t\t|\tscientific name\t|\n2\t|\tnick\t|\t\t|\tsynonym\t|\n3\t|\tS3\t|\t\t|\tscientific name\t|\n4\t|\tS4\t|\t\t|\tscientific name\t|\n")
    (tmp_path / "map").write_text("3\tref0\n4 ref1\n")
    tree = dumps.read_taxonomy(spark, str(tmp_path / "nodes.dmp"), str(tmp_path / "names.dmp"))
    assert [(r["tax_id"], r["parent_id"]) for r in taxonomy.missing_parents(tree).collect()] == [(9, 77)]
    nodes = taxonomy.resolved(tree)
    base = texts()[1]
    refs = sketched(spark, [base, base[:100], "ACGTTGCATGCA" * 6])
    taxa = taxonomy.reference_taxa(refs, dumps.read_mapping(spark, str(tmp_path / "map")))
    assert {r["ref_idx"]: r["tax_id"] for r in taxa.collect()} == {0: 3, 1: 4, 2: 0}
    lca = {r["hash"]: r["tax_id"] for r in taxonomy.hash_taxa(refs, taxa, nodes).collect()}
    held = {r["ref_idx"]: {*r["hashes"]} for r in refs.collect()}
    for h, t in lca.items():
        ids = {taxon for i, taxon in ((0, 3), (1, 4)) if h in held[i]}
        assert t == (0 if not ids else ids.pop() if len(ids) == 1 else 2)
    counts = screen.mixture_counts(spark.createDataFrame([(base,)], "seq string"), P)
    report = taxonomy.report(taxonomy.taxon_counts(taxonomy.hash_taxa(refs, taxa, nodes), counts), nodes)
    rows = report.orderBy("place").collect()
    assert rows[0]["tax_id"] == 1 and rows[1]["tax_id"] == 2 and rows[0]["seen"] == rows[1]["seen"]
    assert formats.report_lines(report).first()["value"].startswith("%\thashes")


def plain_minmers(h, window, size):
    out = set()
    for a in range(max(1, len(h) - min(window, len(h)) + 1) if len(h) else 0):
        frame = h[a : a + window]
        for x in sorted(set(frame))[:size]:
            out.add(a + frame.index(x))
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 12), st.integers(1, 4))
def test_minmers_by_the_definition(h, window, size):
    assert find.leftmost_minmers(np.array(h, np.int64), window, size).tolist() == plain_minmers(h, window, size)


def test_find_places_a_passage(spark):
    rng = np.random.default_rng(5)
    ref = "".join(rng.choice(list("ACGT"), 600))
    refs = spark.createDataFrame([(0, "r", ref), (1, "other", "".join(rng.choice(list("ACGT"), 400)))], "ref_idx long, name string, seq string")
    asked = spark.createDataFrame([(0, "q", ref[200:320]), (1, "r", ref)], "query long, name string, seq string")
    p = SketchParams(kmer=12, sketch_size=1000)
    got = find.find(refs, asked, p, window=10, minmers_per_window=3, threshold=0.1, best=1).collect()
    q = next(r for r in got if r["query"] == 0)
    assert q["ref_idx"] == 0 and 195 <= q["start"] <= 215 and 290 <= q["end"] <= 320 and not q["minus"]
    assert all(r["query_name"] != r["ref_name"] for r in find.find(refs, asked, p, window=10, minmers_per_window=3, exclude_self=True).collect())


FASTX = b"junk\n>a first one\r\nACGT\nAC GT\n\n@b\nACGTA\n+b\n@@@>>\n>c\n\n@d x\nAC\nGT\n+\nII\nII\n"


@pytest.mark.parametrize("packed", [False, True])
def test_sequence_files(spark, tmp_path, packed):
    path = tmp_path / "x.fa"
    path.write_bytes(gzip.compress(FASTX) if packed else FASTX)
    (tmp_path / "y.fa").write_bytes(b"")
    (tmp_path / "list").write_text(f"{path}\n{tmp_path / 'y.fa'}\n")
    got = sequences.read_sequences(spark, sequences.read_list(spark, str(tmp_path / "list"))).orderBy("rec_no").collect()
    assert [(r["name"], r["comment"], bytes(r["seq"]), r["qual"] and bytes(r["qual"])) for r in got] == [("a", "first one", b"ACGTACGT", None), ("b", "", b"ACGTA", b"@@@>>"), ("c", "", b"", None), ("d", "x", b"ACGT", b"IIII")]


def test_delimiters_within_lines():
    """Records start and end wherever a delimiter stands; more qualities than letters are skipped."""
    import io

    text = b"x>a one\nAC>b\nGT@c two\nAA+ rest\nIIII\n@d\nCC\n+\nJ J"
    assert list(sequences.parse(io.BytesIO(text))) == [("a", "one", b"AC", None), ("b", "", b"GT", None), ("c", "two", b"AA", b"II"), ("d", "", b"CC", b"JJ")]


@pytest.mark.parametrize("text", [b"@a\nACGT\n+\nII\n", b"@a\nAC\n+\nI"])
def test_broken_qualities(text):
    import io

    with pytest.raises(sequences.SequenceError):
        list(sequences.parse(io.BytesIO(text)))


def test_store(spark, tmp_path):
    a, b = sketched(spark, texts()[:3]), sketched(spark, texts()[3:5], P.with_(sketch_size=50))
    store.save(a, P, str(tmp_path / "a"))
    store.save(b, P.with_(sketch_size=50), str(tmp_path / "b"))
    store.save(b, P.with_(seed=7), str(tmp_path / "c"))
    assert store.count(spark, str(tmp_path / "a")) == 3 and store.load_params(spark, str(tmp_path / "a")) == P
    with pytest.warns(UserWarning):
        out = store.paste(spark, str(tmp_path / "out"), [str(tmp_path / x) for x in "abc"])
    rows, p = store.load(spark, str(tmp_path / ("out" + store.SUFFIX)))
    assert p == out == P and rows.count() == 5 and rows.agg(F.max("n")).first()[0] <= P.sketch_size
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"), pytest.warns(UserWarning):
        store.paste(spark, str(tmp_path / "out"), [str(tmp_path / x) for x in "ab"])
    assert store.default_path("-") == "stdin" + store.SUFFIX
    with pytest.raises(ValueError):
        store.require_same_options(kmer=3)


def test_streams_agree_with_batches(spark, tmp_path):
    seqs = texts()
    df = spark.createDataFrame([(i % 2, s) for i, s in enumerate(seqs)], "ref_idx long, seq string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.sketch_stream(stream, P, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    key = lambda d: sorted((r["ref_idx"], r["hash"], r["rank"], r["count"]) for r in d.collect())
    assert key(streaming.latest(spark, str(tmp_path / "out"))) == key(sketch.postings(df, P))


def test_sql_functions(spark):
    from quillmer.functions import hashing

    stats.register(spark)
    hashing.register(spark, SketchParams(kmer=5, canonical=False))
    row = spark.sql("SELECT binom_tail(2L, 3L, 0.5D) AS p, sketch_distance(41L, 1000L, 21L) AS d, kmer_hash('ACGTA') AS h, kmer_hash('ACGNA') AS n").first()
    assert row["p"] == pytest.approx(0.5) and float(f"{row['d']:.6g}") == 0.12101 and row["h"] is not None and row["n"] is None


def test_numbers_in_text(spark):
    values = [0.0, 1.0, 0.12101, 4.48626e-214, 1234567.0, 123456.0, 1e-5, 0.0001234567, math.inf, math.nan, 100.0, 0.1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(formats.general(F.col("x"))).collect()]
    assert got == [f"{v:.6g}" for v in values]


class Packed:
    """Writes binary sketch files for the test, by the public encoding: a struct's words are laid out before what it points to."""

    def __init__(self, segments: int) -> None:
        self.segments = [bytearray() for _ in range(segments)]

    def room(self, words: int, segment: int) -> int:
        at = len(self.segments[segment])
        self.segments[segment] += bytes(8 * words)
        return at

    def put(self, segment: int, at: int, value: int, size: int = 8) -> None:
        self.segments[segment][at : at + size] = value.to_bytes(size, "little")

    def point(self, segment: int, at: int, to_segment: int, to: int, kind: int, high: int) -> None:
        if to_segment != segment:  # by way of a pointer that stands there
            pad = self.room(1, to_segment)
            self.put(segment, at, 2 | pad // 8 << 3 | to_segment << 32)
            segment, at = to_segment, pad
        self.put(segment, at, kind | ((to - at - 8) // 8 & 0x3FFFFFFF) << 2 | high << 32)

    def data(self, segment: int, at: int, raw: bytes, code: int, count: int, to_segment: int) -> None:
        to = self.room(-(-len(raw) // 8), to_segment)
        self.segments[to_segment][to : to + len(raw)] = raw
        self.point(segment, at, to_segment, to, 1, code | count << 3)

    def finished(self) -> bytes:
        head = (len(self.segments) - 1).to_bytes(4, "little") + b"".join((len(s) // 8).to_bytes(4, "little") for s in self.segments)
        return head + bytes(-len(head) % 8) + b"".join(self.segments)


def packed(rows, params, place, segments):
    m, last = Packed(segments), segments - 1
    start = m.room(1, 0)
    root = m.room(7, 0)
    m.point(0, start, 0, root, 0, 3 | 4 << 16)
    m.put(0, root, params.kmer, 4)
    m.put(0, root + 8, params.sketch_size, 4)
    m.put(0, root + 12, params.concatenated | (not params.canonical) << 1 | params.preserve_case << 2, 1)
    m.put(0, root + 20, params.seed ^ 42, 4)
    letters = params.alphabet.encode() + b"\0"
    m.data(0, root + 24 + 8 * 2, letters, 2, len(letters), last)
    held = m.room(1, 0)
    m.point(0, root + 24 + 8 * place, 0, held, 0, 1 << 16)
    tag = m.room(1 + 9 * len(rows), last)
    m.point(0, held, last, tag, 1, 7 | 9 * len(rows) << 3)
    m.put(last, tag, len(rows) << 2 | 2 << 32 | 7 << 48)
    for k, (name, comment, length, hashes, counts) in enumerate(rows):
        at = tag + 8 + 72 * k
        m.put(last, at + (8 if length >> 32 else 0), length, 8 if length >> 32 else 4)
        wide = params.use64
        for i, raw, code, n in ((2, name.encode() + b"\0", 2, len(name) + 1), (3, comment.encode() + b"\0", 2, len(comment) + 1), (5 if wide else 4, np.array(hashes, "<u8" if wide else "<u4").tobytes(), 5 if wide else 4, len(hashes)), (6, np.array(counts, "<u4").tobytes(), 4, len(counts))):
            if i != 6 or counts:
                m.data(last, at + 16 + 8 * i, raw, code, n, last)
    return m.finished()


@pytest.mark.parametrize(("kmer", "place", "segments"), [(21, 3, 1), (21, 0, 2), (11, 3, 2)])
def test_binary_sketch_files(spark, tmp_path, kmer, place, segments):
    p = SketchParams(kmer=kmer, sketch_size=4, seed=42 if place == 0 else 7, counts=True)
    top = (1 << 64) - 1 if p.use64 else (1 << 32) - 1
    rows = [("one", "first", 123, [5, 9, top - 1, top], [1, 2, 3, 4]), ("empty", "", 1 << 33, [], []), ("two", "", 77, [1, 2, 3, 4, 6], [9, 8, 7, 6, 5])]
    path = tmp_path / "x.msh"
    path.write_bytes(packed(rows, p, place, segments))
    assert store.is_collection(str(path)) and store.count(spark, str(path)) == 3 and store.load_params(spark, str(path)) == p
    got = store.load(spark, str(path))[0].orderBy("ref_idx").collect()
    form = lambda h: h - (1 << 63) if p.use64 else h
    for r, (name, comment, length, hashes, counts) in zip(got, rows, strict=True):
        assert (r["name"], r["comment"], r["length"], r["hashes"], r["counts"]) == (name, comment, length, [form(h) for h in hashes[:4]], counts[:4])
        assert r["max_hash"] == (form(hashes[:4][-1]) if hashes else None)
