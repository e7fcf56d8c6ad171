"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised backoff weights.

For n from ``ORDER`` down to 2, with h the n - 1 tokens before w and h' the last n - 2 of them,

    P(w | h) = d(r) r / c(h)             if h w was seen r > 0 times in training,
               alpha(h) P(w | h')        otherwise (alpha is 1 for a context never seen),
    P(w)     = d(r) r / N                if the word was seen r > 0 times,
               what is left of 1         for all unseen words together.

``d(r)`` is Katz's discount for r up to ``K`` from the numbers of n-grams (of that n) seen 1..K+1 times, and 1 above;
where the formula gives nothing between 0 and 1 it is (r - 1/2) / r.  A context (or the corpus) without any count up
to ``K`` would leave nothing to unseen words; its divisor is one more.  alpha(h) makes P(. | h) add up to 1.

No table of the corpus is ever in one place.  Texts are turned into chunks of about ``CHUNK_BYTES`` (stored, so that
their numbering holds).  What a chunk has to know it asks of shards, once for each distinct n-gram, level by level:

* word shards add up the chunks' counts of each word (told by its bytes) and answer with count and number; frequent
  words get small numbers;
* the shards of level n (by context) add up the counts of n-grams and answer with the count of each, whether a context
  has a count up to ``K``, and, for contexts from which the chunk has to back off, the numbers of n-grams seen 1..K
  times and what the seen ones hold of the level below.  Every chunk sends with an n-gram what the level below told
  of its last n - 1 words, so that nothing else has to be looked up;
* a context seen more than ``HEAVY`` times is dealt by its second part, the word, to as many shards as needed; a chunk
  asks all of these for their part of the context's figures and adds them up;
* the number of shards of a level follows the number of tokens (``SHARD_TOKENS``).

With all answers the recursion is evaluated for each distinct n-gram of a chunk, and added up by document.  Answers
lie in one file for each chunk and level below the shared folder.

A document is a sequence of words and one end; starts stand before it.

Defined results: a null text counts as empty and has the end alone; a document with a null id takes part in training;
rows of one id are documents each; an empty table gives an empty result; with no training document at all every token
has probability 1 / (number of classes) = 1, that of the unseen; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, buffers, codes, materialize, mix, pack, pick, scratch, string_hashes, text_slices, thrifty, unpack
from .files import publishing, reading

ORDER = 3
K = 5
CHUNK_BYTES = 8 << 20
#: Tokens that a shard of a level is planned for, and occurrences of a context that one shard takes.
SHARD_TOKENS = 1 << 20
HEAVY = 1 << 20
#: Groups in which the shards' figures are added up before the driver gets them.
SUMS = 16
START = 0  # the number of what stands before a document; words have numbers from 1 on
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ROW = "shard int, chunk long, kind int, body binary"
_FIELDS = ["shard", "chunk", "kind", "body"]


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    shard, chunk, kind, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], _FIELDS)


# ---- the model


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..K) from the numbers of n-grams seen 0..K+1 times (those of 0 don't matter)."""
    d = np.array([1.0, *((r - 0.5) / r for r in range(1, K + 1))])
    if n[1]:
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] and common < 1:
                x = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
                if 0 < x < 1:
                    d[r] = x
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c."""
    return np.where(c <= K, d[np.minimum(c, K)], 1.0) * c


class Unigrams:
    """P(w) by the number of times w was seen."""

    def __init__(self, n: np.ndarray, total: int) -> None:
        self.total, self.distinct = total, int(n[1:].sum())
        self.d = discounts(n)
        self.divisor = total + (0 if n[1 : K + 1].any() else 1)
        seen = sum(n[r] * r * self.d[r] for r in range(1, K + 1)) + (total - sum(n[r] * r for r in range(1, K + 1)))
        self.unseen = 1 - float(seen) / self.divisor

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.divisor, self.unseen)


# ---- chunks


def chunks(docs: DataFrame, shards: int, id_col: str, text_col: str) -> DataFrame:
    """Stored rows (shard 0, chunk, kind 0, body): documents, their tokens by place among the chunk's words, the words' training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def made() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            counts = np.concatenate([x[1] for x in held])
            strings = pa.concat_arrays([x[3] for x in held])
            at = np.cumsum([0, *(len(x[3]) for x in held)])
            raw, offsets = buffers(strings)
            token, distinct = codes(raw, np.diff(offsets))
            token = np.concatenate([token[x[2] + a] for x, a in zip(held, at.tolist(), strict=False)])
            token = np.insert(token, np.cumsum(counts), len(distinct))  # the end, which no word is like, is the empty string
            counts = counts + 1
            order = np.argsort(-np.bincount(token, minlength=len(distinct) + 1), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            token = place[token]
            distinct = pa.concat_arrays([distinct, pa.array([b""], distinct.type)]).take(pa.array(order))
            out = np.array([held_out(x) for x in ids.to_pylist()], bool)
            train = np.bincount(token[np.repeat(~out, counts)], minlength=len(order))
            raw, offsets = buffers(distinct)
            body = pack(
                ids=ids.fill_null(0).to_numpy().view(np.uint64), nulls=ids.is_null().to_numpy(zero_copy_only=False).view(np.uint8), held=out.view(np.uint8), counts=counts, token=token,
                raw=raw, lens=np.diff(offsets), shard=(string_hashes(distinct) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), train=train,
            )
            return _rows([(0, part << 24 | number, 0, body)])

        for b in text_slices(batches, "text"):
            words = Words(*buffers(b.column("text")), lower=True)
            held.append((b.column("id").cast(pa.int64()), words.counts, *words.codes()))
            size += len(words.raw) + 64 * b.num_rows
            if size >= CHUNK_BYTES:
                yield made()
                number, held, size = number + 1, [], 0
        if held:
            yield made()

    return materialize(pick(docs, id=id_col, text=text_col).mapInArrow(thrifty(run), ROW), "lm-chunks")


def _file(folder: str, level: int, chunk: int) -> str:
    return f"{folder}/level{level}-{chunk}.bin"


def _answers(folder: str, level: int, chunk: int) -> dict[str, np.ndarray]:
    with reading(_file(folder, level, chunk)) as src:
        return unpack(src.read())


def _kept(told: DataFrame, level: int, folder: str, partitions: int) -> np.ndarray:
    """Write each chunk's answers (kind 4), those of the shards one after another, to a file; the sum of the shards' figures (kind 5)."""

    def keep(t: pa.Table) -> pa.Table:
        chunk, bodies = t.column("chunk")[0].as_py(), t.column("body").to_pylist()
        if chunk < 0:
            total = sum(unpack(b)["n"].astype(np.int64) for b in bodies)
            return pa.Table.from_batches([_rows([(0, chunk, 5, pack(n=total))])])
        got = [unpack(bodies[i]) for i in np.argsort(t.column("shard").to_numpy(), kind="stable")]
        with publishing(_file(folder, level, chunk)) as out:
            out.write(pack(**{k: np.concatenate([g[k].astype(np.float64 if g[k].dtype.kind == "f" else np.int64) for g in got]) for k in got[0]}))
        return pa.Table.from_batches([_rows([])])

    # the shards' own figures are dealt too, and added up before the driver gets them
    told = told.withColumn("chunk", F.when(F.col("kind") == 5, -1 - F.pmod("shard", F.lit(SUMS))).otherwise(F.col("chunk")))
    sums = materialize(told.repartition(partitions, "chunk").groupBy("chunk").applyInArrow(thrifty(keep), ROW), "lm-told")
    return sum((unpack(r["body"])["n"].astype(np.int64) for r in sums.select("body").toLocalIterator()), np.zeros(K + 4, np.int64))


def word_counts(table: DataFrame, shards: int, folder: str) -> Unigrams:
    """Counts and numbers of all words, in one file for each chunk; the unigram model."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body").to_pylist(), strict=True):
                x = unpack(body)
                lens, shard = x["lens"].astype(np.int64), x["shard"].astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                ends = np.cumsum(lens)
                for s, (a, z) in enumerate(zip(cut, cut[1:], strict=False)):
                    if z > a:
                        o = order[a:z]
                        at = np.cumsum(lens[o])
                        spans = np.arange(at[-1]) + np.repeat(ends[o] - at, lens[o])
                        yield _rows([(s, chunk, 0, pack(raw=x["raw"][spans], lens=lens[o], train=x["train"][o]))])

    def answer(t: pa.Table) -> pa.Table:
        shard, chunk = t.column("shard")[0].as_py(), t.column("chunk").to_pylist()
        got = [unpack(x) for x in t.column("body").to_pylist()]
        at, words = codes(np.concatenate([g["raw"] for g in got]), np.concatenate([g["lens"] for g in got]).astype(np.int64))
        count = np.bincount(at, weights=np.concatenate([g["train"] for g in got]), minlength=len(words)).astype(np.int64)
        place = np.empty(len(words), np.int64)
        # frequent words first; equal counts by the words' bytes, so that numbers hold when a task runs again
        alphabetic = np.empty(len(words), np.int64)
        alphabetic[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        order = np.lexsort((alphabetic, -count))
        place[order] = np.arange(len(words))
        number, rows, ends = place * shards + shard + 1, [], np.cumsum([len(g["lens"]) for g in got])
        for c, g, z in zip(chunk, got, ends.tolist(), strict=True):
            mine = at[z - len(g["lens"]) : z]
            rows.append((shard, c, 4, pack(count=count[mine], number=number[mine])))
        n = np.bincount(np.minimum(count, K + 2), minlength=K + 4)
        n[K + 3] = count.sum()
        rows.append((shard, -1, 5, pack(n=n)))
        return pa.Table.from_batches([_rows(rows)])

    told = table.mapInArrow(thrifty(ask), ROW).repartition(shards, "shard").groupBy("shard").applyInArrow(thrifty(answer), ROW)
    n = _kept(told, 1, folder, shards)
    return Unigrams(n[: K + 3], int(n[K + 3]))


# ---- levels


class Chunk:
    """A chunk's tokens with ``order - 1`` starts before each document, and what the words' shards told."""

    def __init__(self, body: bytes, folder: str, chunk: int, order: int) -> None:
        x, told = unpack(body), _answers(folder, 1, chunk)
        self.ids, self.nulls, self.held = x["ids"].astype(np.uint64).view(np.int64), x["nulls"].astype(bool), x["held"].astype(bool)
        self.lens = x["counts"].astype(np.int64)
        del x["raw"]
        v = self.words = len(x["lens"])
        by_shard = np.argsort(x["shard"], kind="stable")
        self.count, self.number = np.empty(v, np.int64), np.full(v + 1, START)
        self.count[by_shard], self.number[by_shard] = told["count"], told["number"]
        self.by_number = np.argsort(self.number[:v])
        self.rank = np.empty(v, np.int64)
        self.rank[self.by_number] = np.arange(v)
        first = np.cumsum(self.lens) - self.lens
        self.first = first
        token = x["token"].astype(np.int32)
        self.tokens = np.insert(token, np.repeat(first, order - 1), v) if order > 1 else token
        #: place of each token among them
        self.at = np.arange(len(token)) + (order - 1) * np.repeat(np.arange(1, len(first) + 1), self.lens)
        self.token = token
        self.train = np.repeat(~self.held, self.lens)
        self.documents = int(self.count[np.flatnonzero(x["lens"] == 0)].sum())  # trained ones: times that the end, the empty string, was seen


def folded(x: np.ndarray) -> np.ndarray:
    """Numbers of small magnitude as small numbers from 0 on."""
    return x << 1 ^ x >> 63


def unfolded(x: np.ndarray) -> np.ndarray:
    return x >> 1 ^ -(x & 1)


class Level:
    """The distinct n-grams of a chunk, by shard, context and word."""

    def __init__(self, chunk: Chunk, n: int, below: Level | None, shards: int, heavy: int) -> None:
        v, at = chunk.words, chunk.at
        self.n, self.below = n, below
        # contexts: words, or n-grams of the level below, that stand before a token; the last one is the starts
        inner = np.flatnonzero(chunk.tokens[at - 1] != v)
        if n == 2:
            context, columns = chunk.tokens[at - 1], [chunk.number]
        else:
            context = np.full(len(at), len(below.r), np.int32)
            context[inner] = below.gram[inner - 1]
            columns = [np.append(c, START) for c in below.grams]
        used = np.bincount(context, minlength=len(columns[0])) > 0
        context = (np.cumsum(used, dtype=np.int32) - 1)[context]
        self.columns = [c[used] for c in columns]
        # times that a context was seen: those of its n - 1 tokens, or of all documents' starts
        total = np.full(len(self.columns[0]), chunk.documents, np.int64)
        total[context[inner]] = chunk.count[chunk.tokens[at[inner] - 1]] if n == 2 else below.r[below.gram[inner - 1]]
        self.total = total
        # a heavy context is dealt to several shards by the word
        parts = np.maximum(1, -(-total // heavy))
        base = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(parts)), parts)
        part = np.arange(len(owner)) - base[owner]
        h = np.zeros(len(total), np.uint64)
        for c in self.columns:
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + c.astype(np.uint64) + np.uint64(1))
        shard = (mix(h[owner] + part.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.owner, self.part, self.shard = owner[order], part[order], shard[order]
        self.split = (parts > 1)[self.owner]
        word = chunk.token
        pick_ = context
        if len(owner) > len(parts):
            pick_ = base[context] + (mix(chunk.number[word].astype(np.uint64)) % parts[context].astype(np.uint64)).astype(np.int64)
        key, gram = np.unique(place[pick_] << 32 | chunk.rank[word], return_inverse=True)
        del pick_, place
        self.gram = gram.astype(np.int32)
        del gram
        self.entry, self.word = (key >> 32).astype(np.int32), chunk.by_number[key & 0xFFFFFFFF].astype(np.int32)
        self.train = np.bincount(self.gram, weights=chunk.train, minlength=len(key)).astype(np.int32)
        self.many = np.bincount(self.entry, minlength=len(order))
        self.widest = int(chunk.number.max())
        self.last = chunk.number[self.word].astype(np.int32 if self.widest < 1 << 31 else np.int64)
        if below is not None:
            #: the n-gram's last n - 1 tokens, and the context's last n - 2, on the level below
            self.lower, self.lower_context = np.empty(len(key), np.int32), np.empty(len(total), np.int32)
            self.lower[self.gram] = below.gram
            self.lower_context[context] = below.owner[below.entry[below.gram]]

    def asked(self, chunk: Chunk, shards: int) -> Iterator[tuple[int, bytes]]:
        """What each shard is asked."""
        cut, at = np.searchsorted(self.shard, np.arange(shards + 1)), np.append(0, np.cumsum(self.many))
        number = chunk.number[self.word]
        known = chunk.count[self.word] if self.below is None else self.below.r[self.lower]
        for s, (a, z) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False)):
            if z > a:
                g = slice(int(at[a]), int(at[z]))
                starts = at[a:z][self.many[a:z] > 0] - at[a]
                step = np.diff(number[g], prepend=0)
                step[starts] = number[g][starts]  # words rise within a context
                own = {f"u{i}": c[self.owner[a:z]] for i, c in enumerate(self.columns)}
                own["u0"] = folded(np.diff(own["u0"], prepend=0))
                if self.below is not None:
                    own["divisor"] = self.below.divisor[self.lower_context[self.owner[a:z]]]
                yield s, pack(**own, part=self.part[a:z], split=self.split[a:z].view(np.uint8), many=self.many[a:z], step=step, train=self.train[g], known=known[g])

    def settle(self, told: dict[str, np.ndarray], d: np.ndarray, lower: np.ndarray) -> None:
        """Take the shards' answers: counts, divisors and P of each n-gram; ``lower`` is P of its last n - 1 tokens."""
        self.r = told["r"].astype(np.int64)
        contexts = len(self.total)
        none = np.zeros(len(self.many), bool)
        none[self.entry[self.r == 0]] = True
        needs = none | self.split
        owner = self.owner[needs]
        small = np.stack([np.bincount(owner, weights=told[f"n{k}"], minlength=contexts) for k in range(1, K + 1)])
        held = np.bincount(owner, weights=told["lower"], minlength=contexts)
        bare = np.zeros(contexts, bool)
        bare[self.owner[told["bare"].astype(bool)]] = True
        whole = np.zeros(contexts, bool)
        whole[self.owner[self.split]] = True
        bare = np.where(whole, small.sum(axis=0) == 0, bare) & (self.total > 0)
        self.divisor = self.total + bare
        r = np.arange(1, K + 1)[:, None]
        left = self.total - (small * r * (1 - d[1:, None])).sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(self.total > 0, (1 - left / self.divisor) / (1 - held), 1.0)
            context = self.owner[self.entry]
            self.p = np.where(self.r > 0, discounted(self.r, d) / self.divisor[context], alpha[context] * lower)
        #: the n words of each n-gram, by number
        self.grams = [*(c.astype(np.int32 if self.widest < 1 << 31 else np.int64)[context] for c in self.columns), self.last]
        del self.columns, self.part, self.shard, self.split, self.many, self.train, self.word, self.below  # the level above needs none of these


def joint(columns: list[np.ndarray]) -> np.ndarray:
    """Numbers 0.. of the distinct rows that the columns make up, in their order."""
    _, out = np.unique(columns[0], return_inverse=True)
    for c in columns[1:]:
        values, place = np.unique(c, return_inverse=True)
        _, out = np.unique(out * len(values) + place, return_inverse=True)
    return out


def answers(t: pa.Table, n: int, known_p) -> pa.Table:
    """Of one shard: for each chunk (kind 4) what it asked, and (kind 5) how many n-grams were seen 1.. times.

    ``known_p(counts, divisors)``: P on the level below of n-grams seen so many times (divisors: of each context).
    """
    shard, chunk = t.column("shard")[0].as_py(), t.column("chunk").to_pylist()
    got = [unpack(x) for x in t.column("body").to_pylist()]
    names = [*(f"u{i}" for i in range(n - 1)), "part", "split", "many", *(["divisor"] if n > 2 else [])]
    entries, grams = {k: [] for k in names}, {k: [] for k in ("word", "train", "known")}
    for g in got:
        many, step = g["many"].astype(np.int64), g.pop("step").astype(np.int64)
        g["u0"] = np.cumsum(unfolded(g["u0"].astype(np.int64)))
        run = np.cumsum(step)
        starts = (np.cumsum(many) - many)[many > 0]
        grams["word"].append(run - np.repeat(run[starts] - step[starts], many[many > 0]))
        for k in ("train", "known"):
            grams[k].append(g.pop(k).astype(np.int64))
        for k in names:
            entries[k].append(g[k].astype(np.int64))
    sizes = [(len(x), len(y)) for x, y in zip(entries["many"], grams["word"], strict=True)]
    e, g = ({k: np.concatenate(x) for k, x in y.items()} for y in (entries, grams))
    del got, entries, grams
    context = joint([e[f"u{i}"] for i in range(n - 1)] + [e["part"]])
    contexts = int(context.max()) + 1
    of = np.repeat(context, e["many"])
    words, word = np.unique(g["word"], return_inverse=True)
    key = of * len(words) + word
    del of, word, g["word"]
    keys, at, gram = np.unique(key, return_index=True, return_inverse=True)
    del key
    seen = np.bincount(gram, weights=g["train"], minlength=len(keys)).astype(np.int64)
    mine = keys // max(len(words), 1)
    small = np.stack([np.bincount(mine[seen == k], minlength=contexts) for k in range(1, K + 1)])
    divisor = np.repeat(e["divisor"], e["many"])[at] if n > 2 else None
    held = np.bincount(mine, weights=np.where(seen > 0, known_p(g["known"][at], divisor), 0.0), minlength=contexts)
    any_ = np.bincount(mine[seen > 0], minlength=contexts) > 0
    bare = any_ & (small.sum(axis=0) == 0)
    r, rows, a, b = seen[gram], [], 0, 0
    del gram, keys, at, mine, g
    for c, (x, y) in zip(chunk, sizes, strict=True):
        mine_e, rr = context[a : a + x], r[b : b + y]
        needs = e["split"][a : a + x].astype(bool)
        needs[np.repeat(np.arange(x), e["many"][a : a + x])[rr == 0]] = True
        need = mine_e[needs]
        rows.append((shard, c, 4, pack(r=rr, bare=bare[mine_e].view(np.uint8), lower=held[need], **{f"n{k}": small[k - 1, need] for k in range(1, K + 1)})))
        a, b = a + x, b + y
    n_seen = np.bincount(np.minimum(seen, K + 2), minlength=K + 4)
    rows.append((shard, -1, 5, pack(n=n_seen)))
    return pa.Table.from_batches([_rows(rows)])


class Model:
    """What the driver knows: the word model, and discounts and shards of the levels settled so far."""

    def __init__(self, words: Unigrams, shards: int, heavy: int, order: int) -> None:
        self.words, self.shards, self.heavy, self.order = words, shards, heavy, order
        self.d: list[np.ndarray] = []

    def levels(self, chunk: Chunk, folder: str, number: int) -> Level | None:
        """The highest level settled so far, for one chunk."""
        below = None
        for n, d in enumerate(self.d, 2):
            level = Level(chunk, n, below, self.shards, self.heavy)
            level.settle(_answers(folder, n, number), d, self.words.p(chunk.count)[level.word] if below is None else below.p[level.lower])
            below = level
        return below


def settle_level(table: DataFrame, model: Model, folder: str) -> None:
    """Settle the next level: its answers in one file for each chunk, its discounts in ``model``."""
    n, shards = len(model.d) + 2, model.shards

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, body in zip(b.column("chunk").to_pylist(), b.column("body").to_pylist(), strict=True):
                chunk = Chunk(body, folder, number, model.order)
                level = Level(chunk, n, model.levels(chunk, folder, number), shards, model.heavy)
                for s, asked in level.asked(chunk, shards):
                    yield _rows([(s, number, 2, asked)])

    def known_p(count: np.ndarray, divisor: np.ndarray | None) -> np.ndarray:
        if divisor is None:
            return model.words.p(count)
        with np.errstate(divide="ignore", invalid="ignore"):
            return discounted(count, model.d[-1]) / divisor

    asked = table.mapInArrow(thrifty(ask), ROW)
    told = asked.repartition(shards, "shard").groupBy("shard").applyInArrow(thrifty(lambda t: answers(t, n, known_p)), ROW)
    model.d.append(discounts(_kept(told, n, folder, shards)))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every document, by n-grams of up to ``order`` tokens."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch(spark, "lm-files")
    table = chunks(docs, shards, id_col, text_col)
    words = word_counts(table, shards, folder)
    model = Model(words, max(shards, -(-words.total // SHARD_TOKENS)), HEAVY, order)
    for _ in range(2, order + 1):
        settle_level(table, model, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, body in zip(b.column("chunk").to_pylist(), b.column("body").to_pylist(), strict=True):
                chunk = Chunk(body, folder, number, order)
                top = model.levels(chunk, folder, number)
                p = words.p(chunk.count)[chunk.token] if top is None else top.p[top.gram]
                c = chunk.count[chunk.token]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(chunk.ids, pa.int64(), mask=chunk.nulls),
                        "held_out": pa.array(chunk.held),
                        "n_tokens": chunk.lens,
                        "n_known": np.add.reduceat((c > 0).astype(np.int64), chunk.first),
                        "train_tokens": np.full(len(chunk.lens), words.total, np.int64),
                        "base_score": np.add.reduceat(np.log10(c + 1.0), chunk.first) - chunk.lens * np.log10(words.total + words.distinct + 1),
                        "score": np.add.reduceat(np.log10(p), chunk.first),
                    }
                )

    return table.mapInArrow(thrifty(run), SCHEMA)
