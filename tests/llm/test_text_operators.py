"""Corpus operators on texts, each against a plain version, with nulls, empties, long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmer.llm import bpe, common, katz, licenses, mixing, quality, simhash, suffixes, tokenids
from quillmer.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
RNG = random.Random(11)
SYLLABLES = ["an", "der", "Thé", "of", "ß", "x", "ing", "日本", "Q", "re"]


def prose(n):
    return "".join(" ".join("".join(RNG.choice(SYLLABLES) for _ in range(RNG.randint(1, 3))) for _ in range(12)) + RNG.choice([". ", ".\n", "\n\n", "\t"]) for _ in range(n))


PASSAGE = prose(4)
TEXTS = [
    None, "", " \n\t", "one", "two words", prose(3), prose(3), PASSAGE, PASSAGE, PASSAGE + prose(1), prose(1) + PASSAGE, "word " * 400, "a" * 5000, "dup\ndup\nx\ndup\n", "é" * 300 + " " + "é" * 300,
    prose(60), "Released under the MIT License.", "x\n" + "This work is licensed under the GNU General Public License, version 3.\n" * 3, "<|endoftext|> \x01 \x00 　 \x85\x1c z", PASSAGE.upper(),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i else None, f"extra{i}", i, "k") for i, t in enumerate(TEXTS)]
    rows += [(7, PASSAGE, "s1", "again", 0, "k"), (None, PASSAGE, "s2", "no id", 0, "k")]
    # columns that clash with the operators' own names
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string, kept int, gone string").repartition(3).persist()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


def base(t):
    w = WORD.findall(t)
    seen, lines = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, len(covered)


def test_quality(spark, docs, plain, nothing):
    trusted = spark.createDataFrame([(5,), (15,), (None,), (5,)], "doc_id long")
    ratios = quality.log_ratios(docs, trusted)
    got = by_id(quality.judge(docs, ratios).collect())
    assert sum(map(len, got.values())) == len(plain)
    # the model by the definition, over the operator's own buckets
    def buckets(t):
        words = common.Words(*common.buffers(pa.array([t])))
        return quality.features(words, words.hashes())[0]

    total = np.zeros((2, 1 << quality.BUCKET_BITS))
    for i, t in plain:
        np.add.at(total[0], buckets(t), 1)
        if i in (5, 15):
            np.add.at(total[1], buckets(t), 1)
    p = (total + 1) / (total.sum(axis=1, keepdims=True) + total.shape[1])
    expected = np.log(p[1]) - np.log(p[0])
    assert np.allclose(ratios, expected)
    for i, t in plain:
        counts, feats = base(t), buckets(t)
        score = expected[feats].mean() if len(feats) else 0.0
        for r in got[i]:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
            assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
            assert r["score"] == pytest.approx(score) and r["kept"] == (not r["base_failed"] and score >= quality.THRESHOLD)
    kept = quality.keep_good(docs, ratios)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for x in got.values() for r in x)
    assert quality.judge(nothing, quality.log_ratios(nothing, trusted)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\té日$", max_size=40), max_size=6))
def test_words_by_the_definition(texts):
    words = common.Words(*common.buffers(pa.array(texts, pa.string())))
    found = [bytes(words.raw[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert [found[a:b] for a, b in zip(words.first, words.first[1:], strict=False)] == [WORD.findall(t) for t in texts]


def thue_morse(first, second, n=1024):
    return "".join((first, second)[k.bit_count() & 1] for k in range(n))


def test_strings_that_a_polynomial_hash_confuses(spark):
    """Equality is that of bytes: these two have one hash by any polynomial modulo 2**64."""
    x, y = thue_morse("a", "b"), thue_morse("b", "a")
    df = spark.createDataFrame([(0, f"{x}\n{y}\n{x}"), (1, x), (2, y), (4, x)], "doc_id long, text string")
    rows = by_id(quality.judge(df, np.zeros(1 << 16)).collect())
    assert [rows[i][0]["n_dup_lines"] for i in (0, 1)] == [1, 0]
    many = " ".join([*[x] * 5, *[y] * 5])
    assert quality.judge(spark.createDataFrame([(0, many)], "doc_id long, text string"), np.zeros(1 << 16)).first()["n_repeat_words"] == base(many)[4] == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][0]
    trained = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][0]
    got = by_id(katz.scores(spark.createDataFrame([(held, y), (trained, x)], "doc_id long, text string")).collect())
    assert (got[held][0]["n_known"], got[trained][0]["n_known"]) == (1, 2) and got[held][0]["score"] < got[trained][0]["score"]


def fingerprint(t):
    w = WORD.findall(t.translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_simhash(docs, plain, nothing):
    fps = {i: fingerprint(t) for i, t in plain if i is not None}
    expected = components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    rows = simhash.near_duplicates(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    assert set(got) == {*fps, None} and len(rows) == len(got)
    no_id = got.pop(None)  # a copy of document 7
    assert (no_id["fingerprint"], no_id["component_id"]) == (f"{fps[7]:016x}", expected[7])
    for i, r in got.items():
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[i]:016x}", expected[i])
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_rows_of_one_id_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b), (None, b), (None, c), (None, c), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (4, 4), (5, 1), (5, 1), (9, 1)]
    apart = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(df, ids_are_nodes=False).collect()}
    assert sorted(v for (i, _), v in apart.items() if i == 5) == [1, 5]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=150), min_size=1, max_size=8))
def test_xxh64_by_the_library(parts):
    data = np.frombuffer(b"".join(parts) + b"\0" * 8, np.uint8)
    lens = np.array([len(p) for p in parts], np.int64)
    got = simhash.xxh64(data, np.cumsum(lens) - lens, lens)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_simhash_links_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)  # several levels
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 1 << 62, 60)}
    for seed in list(fps)[:3]:
        chain = seed
        for _ in range(60):
            chain ^= 1 << int(rng.integers(62))
            fps.add(chain)
    nodes = sorted(fps)
    expected = components(nodes, lambda a, b: (a ^ b).bit_count() <= 4)
    edges = simhash.links(spark.createDataFrame([(x,) for x in nodes], "fp long"))
    got = {x: x for x in nodes} | {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == expected


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=50), st.integers(2, 4), st.sets(st.integers(0, 63), max_size=4))
def test_masks_lose_no_link(agreed, keep, differ):
    have = sum(1 << i for i in agreed)
    change = sum(1 << i for i in differ - agreed)
    found = simhash.masks(have, keep)
    assert all(m & have == have for m in found) and any(not m & change for m in found)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (None, 3), (129, 5)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 71
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed_bytes(plain, length):
    seen, out = {}, {}
    for i, t in sorted({(common_id(i), t) for i, t in plain}):
        data = t.encode()
        gone = out.setdefault(i, bytearray(len(data)))
        for k in range(len(data) - length + 1):
            if seen.setdefault(data[k : k + length], (i, k)) != (i, k):
                gone[k : k + length] = b"\1" * length
    return out


def common_id(i):
    return suffixes.LAST if i is None else i


def test_suffix_dedup(docs, plain, nothing):
    gone = removed_bytes(plain, 100)
    got = by_id(suffixes.digests(docs).collect())
    cut = by_id(suffixes.deduplicated(docs).collect())
    for i, t in plain:
        data, mask = t.encode(), gone[common_id(i)]
        kept = bytes(c for c, g in zip(data, mask, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(mask) if g and not (k and mask[k - 1]))
        for r in got[i]:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), sum(mask), runs, hashlib.sha256(kept).hexdigest())
        for r in cut[i]:
            assert (r["text"] or "") == kept.decode("utf-8", "ignore")
    assert suffixes.digests(nothing).count() == 0 and suffixes.deduplicated(docs).columns == docs.columns


def test_suffix_dedup_of_null_and_repeated_ids(spark):
    """Rows of one id, or of none, with different texts lose only what they share with an earlier document."""
    rng = random.Random(3)
    p, u, v, w = (bytes(rng.choices(range(97, 123), k=n)).decode() for n in (300, 500, 400, 350))
    rows = [(3, p), (None, u), (None, p), (None, v + u[:200]), (8, w), (8, v), (8, w), (9, u[100:250] + w)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for r in suffixes.digests(df).collect():
        got[r["doc_id"], r["n_bytes"]].append(r["n_removed"])
    assert got[3, 300] == [0] and got[None, 300] == [300]
    assert got[8, 350] == [0, 0] and got[8, 400] == [0] and got[9, 500] == [350]
    # document 9 has bytes 100-250 of u, document 8 has v; of the two rows without id that share u[:200] one loses all of it
    assert (got[None, 500][0], got[None, 600][0]) in {(150, 600), (250, 500)}


def test_suffix_dedup_where_one_name_has_much(monkeypatch):
    """Pieces of one name beyond an array's size are cut again."""
    monkeypatch.setattr(suffixes, "PART_BYTES", 3000)
    rng = random.Random(4)
    shared = "".join(rng.choices("abcdefgh", k=60))
    texts = ["".join(rng.choices("abc", k=150)) + shared + "".join(rng.choices("abc", k=150)) for _ in range(60)]
    texts += [texts[k][100:320] for k in range(0, 60, 7)]
    raw, offsets = common.buffers(pa.array(texts, pa.string()))
    text, start, windows, name, gram = (np.concatenate(x) for x in zip(*suffixes.pieces(raw, offsets), strict=True))
    name[:] = 1  # as if all had one gram as their least
    found = defaultdict(list)
    for d, a, z in suffixes.settle(raw, start, windows + 99, text, start - offsets[text], name.astype(np.int64), gram, 100):
        for x in zip(d.tolist(), a.tolist(), z.tolist(), strict=True):
            found[x[0]] += x[1:]
    gone = removed_bytes(list(enumerate(texts)), 100)
    for i, t in enumerate(texts):
        assert suffixes._kept(t.encode(), found[i])[0] == bytes(c for c, g in zip(t.encode(), gone[i], strict=True) if not g)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=80) | st.text("ab", max_size=80).map(str.encode) | st.integers(1, 60).map(lambda n: b"abaab" * n))
def test_suffix_array_by_sorting(data):
    assert suffixes.suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["abcabcabcabcabcabcabcabcabcd", "xyzzyxyzzyxyzzyxyzzyqq", "q", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]), max_size=6).map("".join), max_size=6), st.sampled_from([20, 24]))
def test_repeats_over_shards_and_tasks(texts, length):
    plain = list(enumerate(texts))
    gone = removed_bytes(plain, length)
    shards = defaultdict(list)
    for half in (plain[::2], plain[1::2]):
        box = suffixes.Outbox(3, length)
        if half:
            box.add(*common.buffers(pa.array([t for _, t in half], pa.string())), np.array([i for i, _ in half]))
        for b in box.flush():
            shards[b.column("shard")[0].as_py()].append(b.column("body")[0].as_py())
    found = defaultdict(list)
    for bodies in shards.values():
        key, start, end = suffixes.shard_repeats(bodies, length)
        for d, a, z in zip(key[0].tolist(), start.tolist(), end.tolist(), strict=True):
            found[d] += [a, z]
    for i, t in plain:
        kept, _ = suffixes._kept(t.encode(), found[i])
        assert kept == bytes(c for c, g in zip(t.encode(), gone[i], strict=True) if not g)


def test_segments_of_a_long_text(monkeypatch):
    text = (prose(30) + PASSAGE + prose(2) + PASSAGE).encode()
    raw, offsets = common.buffers(pa.array([text], pa.binary()))
    whole = sum(int(x[2].sum()) for x in suffixes.pieces(raw, offsets))
    monkeypatch.setattr(suffixes, "SEGMENT", 256)
    assert whole == sum(int(x[2].sum()) for x in suffixes.pieces(raw, offsets)) == len(text) - 99


def katz_by_the_definition(plain, order):
    """(score, base score, tokens, known) of each text, and the words' number; the recursion as it stands in the docstring."""
    words = [(WORD.findall(t.translate(LOWER)) + ["</s>"], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in plain]
    grams = [Counter() for _ in range(order + 1)]
    for w, out in words:
        for n in range(1, order + 1):
            padded = ["<s>"] * (n - 1) + w
            if not out:
                grams[n].update(tuple(padded[k : k + n]) for k in range(len(w)))
    total = sum(grams[1].values())

    def discount(counts):
        n, out = Counter(counts.values()), {}
        common_ = 6 * n[6] / n[1] if n[1] else 9
        for r in range(1, 6):
            out[r] = (r - 0.5) / r
            if n[1] and n[r] and common_ < 1 and 0 < (x := ((r + 1) * n[r + 1] / n[r] / r - common_) / (1 - common_)) < 1:
                out[r] = x
        return out

    d = [discount(g) for g in grams]
    context = defaultdict(dict)
    for g in grams[2:]:
        for x, r in g.items():
            context[x[:-1]][x[-1]] = r
    bottom = total + (0 if any(r <= 5 for r in grams[1].values()) else 1)
    pu = {w: d[1].get(r, 1) * r / bottom for (w,), r in grams[1].items()}
    unseen, weights = 1 - sum(pu.values()), {}

    def probability(h, w):
        if not h:
            return pu.get(w, unseen)
        seen = context.get(h)
        if not seen:
            return probability(h[1:], w)
        n = len(h) + 1
        below = sum(seen.values()) + (0 if any(r <= 5 for r in seen.values()) else 1)
        if w in seen:
            return d[n].get(seen[w], 1) * seen[w] / below
        if h not in weights:
            weights[h] = (1 - sum(d[n].get(r, 1) * r for r in seen.values()) / below) / (1 - sum(probability(h[1:], x) for x in seen))
        return weights[h] * probability(h[1:], w)

    for h in sorted(context, key=lambda h: (-len(h), h))[:12]:
        assert sum(probability(h, w) for (w,) in [*grams[1], ("never seen",)]) == pytest.approx(1)
    out = []
    for w, held in words:
        padded = ["<s>"] * (order - 1) + w
        score = sum(math.log10(probability(tuple(padded[k : k + order - 1]), x)) for k, x in enumerate(w))
        base_score = sum(math.log10((grams[1][x,] + 1) / (total + len(grams[1]) + 1)) for x in w)
        out.append((held, len(w), sum(grams[1][x,] > 0 for x in w), total, base_score, score))
    return out


@pytest.mark.parametrize(("order", "heavy"), [(3, katz.HEAVY), (3, 3), (2, 5), (1, 9), (4, katz.HEAVY)])
def test_katz(docs, plain, nothing, monkeypatch, order, heavy):
    monkeypatch.setattr(katz, "HEAVY", heavy)
    monkeypatch.setattr(katz, "CHUNK_BYTES", 4000 if heavy == 3 else katz.CHUNK_BYTES)
    got = by_id(katz.scores(docs, order=order).collect())
    assert sum(map(len, got.values())) == len(plain)
    for (i, _), expected in zip(plain, katz_by_the_definition(plain, order), strict=True):
        r = next(r for r in got[i] if r["n_tokens"] == expected[1])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == expected[:4]
        assert r["base_score"] == pytest.approx(expected[4], rel=1e-9) and r["score"] == pytest.approx(expected[5], rel=1e-8)
    if order == 3:
        assert katz.scores(nothing).count() == 0


def test_mixing(docs, plain, nothing):
    rows = docs.select("doc_id", "text", "source").collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len((r["text"] or "").encode())
    weight = {s: math.sqrt(n) for s, n in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) / n if n else 0.0 for s, n in size.items()}

    def number(r):
        name = "null" if r["doc_id"] is None else str(r["doc_id"])
        u = int(hashlib.md5(f"{mixing.SEED}:{name}:0".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate[r["source"]])
        k = 0
        while c <= u and k < 200:
            k += 1
            p *= rate[r["source"]] / k
            c += p
        return k

    expected = Counter()
    for r in rows:
        expected[r["doc_id"]] += number(r)
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "rate", "replica", "shuffle_key"]
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == +expected
    assert mixing.mixed(nothing).count() == 0
    # weights that are given; a large rate is made of several parts
    given_ = mixing.mixed(docs, {"s1": 1.0})
    assert {r["source"] for r in given_.collect()} == {"s1"}
    table = {r["source"]: r for r in mixing.rates(docs, {"s0": 0.999, None: 0.001}).collect()}
    assert table["s1"]["rate"] == 0 and sum((r["rate"] or 0) * size[s] for s, r in table.items()) == pytest.approx(sum(size.values()), rel=0.01)


def test_mixing_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(i, "text", "s", 0.5, "mine") for i in range(20)], "doc_id long, text string, source string, rate double, Replica string")
    out = mixing.mixed(df)
    assert out.columns == ["doc_id", "text", "source", "rate_", "Replica_", "rate", "replica", "shuffle_key"]
    back = mixing.replicated(df)
    assert back.columns == df.columns and {(r["rate"], r["Replica"]) for r in back.collect()} == {(0.5, "mine")}


def test_mixing_of_large_rates(spark):
    rows = [(i, "x" * 1000, "big") for i in range(200)] + [(1000, "y", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = Counter(r["source"] for r in mixing.mixed(df, {"big": 0.99, "tiny": 0.01}).select("source").collect())
    rate = {r["source"]: (r["rate"], r["parts"]) for r in mixing.rates(df, {"big": 0.99, "tiny": 0.01}).collect()}
    assert rate["tiny"][1] == 5 and abs(n["tiny"] - rate["tiny"][0]) < 6 * math.sqrt(rate["tiny"][0])


def test_token_files(spark, docs, plain, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = sorted((-1 if i is None else i, t.encode(x, add_special_tokens=False).ids + [1]) for i, x in plain)
    got = tokenids.round_trip(docs, path, str(tmp_path / "files")).collect()
    got = sorted(got, key=lambda r: r["start"])
    start = 0
    for r, (i, ids) in zip(got, rows, strict=True):
        assert (-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenids.round_trip(nothing, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_variable_length_coding(values):
    v = np.array(values, np.uint32)
    control, data = tokenids.pack(v)
    assert tokenids.unpack(control, data, len(v)).tolist() == values and len(control) == -(-len(v) // 4)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30) | st.text("aéİß日'.<>|\x01\x85 ", max_size=30), max_size=8))
def test_words_have_the_tokenizer_s_ids(texts):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        ids, bounds = tokenids.WordTokenizer(f.read()).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.fixture(scope="module")
def coders():
    import public_tokenizers
    import tiktoken

    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    return path, public_tokenizers.PATTERN, bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, plain, nothing, coders):
    path, pattern, _, _, reference = coders
    expected = {i: reference.encode_ordinary(t) for i, t in plain}
    for r in bpe.digests(docs, path, pattern).collect():
        ids = expected[r["doc_id"]]
        text = dict(plain)[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decoded(bpe.encoded(docs, path, pattern), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(plain)
    assert bpe.digests(nothing, path, pattern).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab é日ß1.'s\n  ", max_size=80) | st.integers(1, 500).map(lambda n: "ha" * n))
def test_transducer_is_the_reference(coders, text):
    _, _, encoder, decoder, reference = coders
    ids = encoder.encode(text)
    expected = reference.encode_ordinary(text)
    assert ids == ",".join(map(str, expected))
    assert "".join(t for _, t in decoder.stream(np.array(expected, np.int64), 3)) == text


def test_transducer_starts_over_when_full(coders, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    machine = bpe.Transducer(coders[2].machine.ranks)
    for t in TEXTS:
        for piece in coders[2].pieces(t or ""):
            assert machine.encode(piece.encode()) == coders[4].encode_ordinary(piece)
    assert len(machine.states) < 2000


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20), st.integers(1, 4))
def test_utf8_stream(text, step):
    stream, data = bpe.Utf8Stream(), text.encode()
    parts = [stream.feed(data[i : i + step]) for i in range(0, len(data), step)]
    assert "".join(parts) + stream.finish() == text


def test_licenses(docs, nothing):
    got = [(r["doc_id"], r["license"], r["occurrence"], r["coverage"]) for r in licenses.scan(docs).orderBy("doc_id", "occurrence").collect()]
    assert got == [(16, "mit-line", 0, 1.0), *((17, "gpl-3.0-line", k, 1.0) for k in range(3))]
    assert licenses.scan(nothing).count() == 0


def full_alignment(template, text):
    best = [[0] * (len(text) + 1)]
    for i, a in enumerate(template, 1):
        row = [best[-1][0] - 1]
        for j, b in enumerate(text, 1):
            row.append(max(best[-1][j - 1] + (2 if a == b else -1), best[-1][j] - 1, row[-1] - 1))
        best.append(row)
    return max(best[-1])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=8), st.lists(st.integers(0, 4), max_size=12))
def test_banded_alignment_is_the_full_one(template, text):
    pairs = licenses.align(template, text, -len(template), len(text))
    assert all(template[i] == text[j] for i, j in pairs) and pairs == sorted(pairs)
    score = full_alignment(template, text)
    assert 2 * len(pairs) >= score  # the alignment's matches carry at least its score


def test_license_spans_with_changes(spark):
    notice = licenses.TEMPLATES["isc-permission"]
    words = notice.split()
    changed = " ".join(words[:8] + ["really"] + words[8:20] + words[22:])
    text = "é intro " + changed + " tail"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0]["license"] == "isc-permission" and 0.9 < r[0]["coverage"] < 1
    assert text[r[0]["start_char"] : r[0]["end_char"]] == r[0]["matched_text"] and r[0]["matched_text"].startswith("Permission")


NEAR_MISSES = {
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": "lgpl-2.1-line",
    "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0-line",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc-4.0-work",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": None,
    "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0-line",
    "Licensed under CC BY-NC-ND 4.0.": None,
    "Licensed under the GNU General Public License, version 3.": "gpl-3.0-licensed",
    "Licensed under the BSD 4-Clause License.": None,
    "Licensed under CC BY 3.0.": None,
    "Licensed under the Apache License, Version 1.1.": None,
    "Licensed under the Apache License, Version 2.": "apache-2.0-line",
    "Released under a MIT License.": "mit-line",
    "Released under the BSD License.": None,
    "This work is licensed under the GNU General Public License, version 2.0, see below": "gpl-2.0-line",
    "This work is licensed under the GNU General Public License, version 4.": None,
}


def test_licenses_of_like_wording(spark):
    texts = list(NEAR_MISSES)
    rows = licenses.scan(spark.createDataFrame([(i, f"Intro text here. {t} And more.") for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r["license"])
    assert {t: got[i] for i, t in enumerate(texts)} == {t: [x] if x else [] for t, x in NEAR_MISSES.items()}


def scanned(text, templates, coverage=licenses.COVERAGE):
    """All templates against all of a text, without index, candidates or band: names of the occurrences that stay."""
    index = licenses.Index(templates)
    _, code, distinct = licenses.terms(pa.array([text]))
    own = {t: i for i, t in enumerate(index.vocabulary.to_pylist())}
    term = [own.get(t, -2 if t[:1].isdigit() else -1) for t in np.array(distinct.to_pylist(), object)[code]] if len(code) else []
    found = []
    for o, t in enumerate(index.terms):
        begin = 0
        while begin < len(term):  # the best occurrence, then what follows it
            pairs = licenses.align(t.tolist(), term[begin:], -len(t), len(term))
            if len(pairs) < coverage * len(t):
                break
            a, z = begin + pairs[0][1], begin + pairs[-1][1]
            matched = {begin + j for _, j in pairs}
            odd = [term[j] for j in range(a, z + 1) if j not in matched]
            telling = index.telling[o]
            numbers = index.number_like[t[telling]].any()
            if {i for i, _ in pairs} >= set(np.flatnonzero(telling).tolist()) and not any((x >= 0 and (index.rival[x] or numbers and index.number_like[x])) or (x == -2 and numbers) for x in odd):
                found.append((a, z, len(pairs), len(t), o))
            begin = z + 1
    return [(index.names[o], n) for _, _, n, _, o in licenses.settled(found)]


def test_licenses_by_a_scan_of_everything(spark):
    rng = random.Random(5)
    texts = []
    for name, notice in licenses.TEMPLATES.items():
        words = re.sub("[{}]", "", notice).split()
        for rate in (0.0, 0.04, 0.1):
            edited = [w if rng.random() >= rate else rng.choice(["", "other", "words"]) for w in words]
            texts.append((name, "Some words before it of the. " + " ".join(w for w in edited if w) + " And words after."))
    rows = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string").repartition(4)).orderBy("doc_id", "start_char").collect()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["license"], r["matched_terms"]))
    for i, (name, t) in enumerate(texts):
        assert got[i] == scanned(t, licenses.TEMPLATES), t
        if i % 3 == 0:
            assert got[i][0][0] == name
