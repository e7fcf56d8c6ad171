"""Byte-level BPE: merges compiled into a lazily determinised transducer, and a streaming decoder.

Encoding.  A sequence of tokens is the encoding of its bytes exactly if each two neighbours are, and the encoding of a
prefix is that of a shorter prefix and one token more.  So one left-to-right pass suffices.  A state is the list of
the places from which a token can still run on, oldest first, each as (node of the tokens' trie, token that ends
there); on a byte the machine moves each node down the trie, and sends as the label of the byte the one token that ends
here and fits behind the token at its start.  States and transitions are numbered and made when first met, many at once
with whole-array operations: :meth:`Transducer.labels` runs all new pieces of a batch in step, so that pieces with a
common beginning, or with the same live ends, share their states.  The tables are dropped when they hold ``MAX_STATES``.

A token is sent when all live places agree on it: pieces of up to ``BLOCK`` bytes are settled at their end, longer ones
after each ``BLOCK`` bytes as far as the encodings up to all live places agree (:meth:`Transducer.stream`).

Whether two tokens fit behind each other is read off their own merges: undone from the last to the first, no pair
that meets at the border may have a rank that would have come earlier.

Texts are cut at single spaces between visible characters where the pattern is one of ``SPACE_PATTERNS``; the cut
parts are told apart by Arrow's dictionary (exact bytes), and only parts not seen lately go through pattern and machine.
With any other pattern whole texts go through it.

Decoding maps ids to bytes with one array gather and passes them through :class:`Utf8Stream`, which holds back an
unfinished character until its bytes arrive.

Defined results: a null text counts as empty and has no ids; rows are encoded one by one, so that repeated rows
and ties give repeated results; an empty table gives an empty result; other columns are ignored.  Ids outside the
vocabulary raise an error.  Whole texts are encoded; memory is bounded by the longest text and the fixed tables.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import buffers, kept, pick, text_slices, thrifty

MAX_STATES = 500_000
MAX_CACHE = 120_000
#: Bytes of text handled at once, and of a piece that runs in step with others.
SLICE = 1 << 20
#: New parts that run in step.
NEW = 1 << 14
BLOCK = 1024
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Patterns of which no match crosses a single space between two visible characters, as a space there goes with what follows it.
SPACE_PATTERNS = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""}

_TOKEN = 17  # bits of a token's rank, with one value to spare
_NODE = 18  # bits of a trie node


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


class IntMap:
    """Map of non-negative int64 to int64 in open addressing, many keys at a time."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.empty(1 << bits, np.int64)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        h = k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, k: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        slot = self._slot(k)
        have = self.keys[slot]
        out = np.where(have == k, self.values[slot], -1)
        live = np.flatnonzero((have != k) & (have >= 0))
        while len(live):
            slot[live] = at = (slot[live] + 1) & ((1 << self.bits) - 1)
            have = self.keys[at]
            hit = have == k[live]
            out[live[hit]] = self.values[at[hit]]
            live = live[~hit & (have >= 0)]
        return out

    def put(self, k: np.ndarray, v: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if 2 * (self.n + len(k)) > 1 << self.bits:
            full = self.keys >= 0
            old = self.keys[full], self.values[full]
            self.__init__(max(self.bits + 1, int(2 * (self.n + len(k))).bit_length()))
            self.put(*old)
        self.n += len(k)
        slot, todo = self._slot(k), np.arange(len(k))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = k[free]
            mine = self.keys[slot[todo]] == k[todo]
            self.values[slot[todo[mine]]] = v[todo[mine]]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)


class Merges:
    """What the ranks say, in arrays: the tokens' trie, each token's last merge, and which pairs have a rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if ranks and max(ranks.values()) >= (1 << _TOKEN) - 1:
            raise ValueError(f"ranks must be below {(1 << _TOKEN) - 1}")
        size = max(ranks.values(), default=-1) + 1
        self.lens = np.zeros(size, np.int64)
        #: rank of a token of several bytes, which is when it is made; -1 of a single byte
        self.time = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        node: dict[bytes, int] = {b"": 0}
        ends, step, pairs = {}, {}, {}
        for token, rank in ranks.items():
            self.lens[rank] = len(token)
            made = halves(token, ranks)
            if made is None:  # its own bytes give other tokens, so no text gives it
                continue
            if len(token) > 1:
                self.time[rank], (self.left[rank], self.right[rank]) = rank, made
            for n in range(1, len(token) + 1):
                if token[:n] not in node:
                    at = node[token[:n]] = len(node)
                    step[node[token[: n - 1]] << 8 | token[n - 1]] = at
            ends[node[token]] = rank
            for n in range(1, len(token)):
                a, b = ranks.get(token[:n]), ranks.get(token[n:])
                if a is not None and b is not None:
                    pairs[a << _TOKEN | b] = rank
        if len(node) >= 1 << _NODE:
            raise ValueError("too many prefixes")
        self.depth = np.zeros(len(node), np.int64)
        for prefix, at in node.items():
            self.depth[at] = len(prefix)
        self.ends = np.full(len(node), -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.inner = np.zeros(len(node), bool)
        self.inner[[k >> 8 for k in step]] = True
        self.step, self.pairs = IntMap(), IntMap()
        for table, items in ((self.step, step), (self.pairs, pairs)):
            table.put(np.fromiter(items.keys(), np.int64, len(items)), np.fromiter(items.values(), np.int64, len(items)))

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens: is it an encoding?  A left token of -1 is the start."""
        out = np.ones(len(left), bool)
        live = np.flatnonzero(left >= 0)
        a, b = left[live], right[live]
        limit = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            joined = self.pairs.get(a << _TOKEN | b)
            ta, tb = self.time[a], self.time[b]
            bad = (joined >= 0) & (joined < limit)
            out[live[bad]] = False
            on = ~bad & ((ta >= 0) | (tb >= 0))
            live, a, b, ta, tb = live[on], a[on], b[on], ta[on], tb[on]
            first = ta > tb  # of equal ones the left is made first, so the right is undone first
            limit = np.where(first, ta, tb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out


def merge(data: bytes, ranks: dict[bytes, int], keep: int = 1) -> list[bytes]:
    """Encoding by definition, down to ``keep`` parts: join the two neighbours whose union ranks lowest, leftmost first, until none has a rank."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > keep:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens that a token's last merge joins (of a byte: any), or nothing if its bytes are not merged into it."""
    if len(token) == 1:
        return -1, -1
    parts = merge(token, ranks, 2)
    return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 and all(p in ranks for p in parts) else None


class Transducer:
    def __init__(self, ranks: dict[bytes, int], merges: Merges | None = None) -> None:
        self.ranks, self.merges = ranks, merges or Merges(ranks)
        self.reset()

    def reset(self) -> None:
        """A state is a node of a tree of lists: the list of its parent, and one (trie node, token before it) more."""
        self.parent, self.node, self.before = (np.zeros(1 << 12, np.int32) for _ in range(3))
        self.parent[0] = -1
        self.count = 1
        self.number, self.next, self.label = IntMap(), IntMap(), np.zeros(1 << 12, np.int32)
        self.start = int(self._append(np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1))[0])

    @property
    def states(self) -> range:
        return range(self.count)

    def _append(self, state: np.ndarray, node: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Numbers of the lists ``state`` and one entry more."""
        key = state << (_NODE + _TOKEN) | node << _TOKEN | (before + 1)
        out = self.number.get(key)
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh, at, back = np.unique(key[new], return_index=True, return_inverse=True)
            numbers = np.arange(self.count, self.count + len(fresh))
            self.count += len(fresh)
            while self.count > len(self.parent):
                self.parent, self.node, self.before = (np.concatenate([x, np.zeros(len(x), np.int32)]) for x in (self.parent, self.node, self.before))
            self.parent[numbers], self.node[numbers], self.before[numbers] = state[new[at]], node[new[at]], before[new[at]]
            self.number.put(fresh, numbers)
            out[new] = numbers[back]
        return out

    def _build(self, key: np.ndarray) -> None:
        """The transitions ``state << 8 | byte`` that were not met before."""
        m, state, byte = self.merges, key >> 8, key & 0xFF
        rows, at = [], state
        while (at > 0).any():  # newest entry first; lists that are used up have node -1
            rows.append((np.where(at > 0, self.node[at], -1).astype(np.int64), self.before[at].astype(np.int64)))
            at = np.where(at > 0, self.parent[at], 0)
        label, into = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        for node, before in rows[::-1]:
            live = np.flatnonzero(node >= 0)
            down = m.step.get(node[live] << 8 | byte[live])
            on = down >= 0
            live, down = live[on], down[on]
            token, behind = m.ends[down], before[live]
            may = np.flatnonzero((token >= 0) & (label[live] < 0))
            may = may[m.fit(behind[may], token[may])]
            label[live[may]] = token[may]
            more = m.inner[down]
            into[live[more]] = self._append(into[live[more]], down[more], behind[more])
        if (label < 0).any():
            raise ValueError(f"the ranks have no token for byte {int(byte[label < 0][0])}")
        into = self._append(into, np.zeros(len(key), np.int64), label)
        while len(self.label) < self.next.n + len(key):
            self.label = np.concatenate([self.label, np.zeros(len(self.label), np.int32)])
        numbers = np.arange(self.next.n, self.next.n + len(key))
        self.label[numbers] = label
        self.next.put(key, into << 32 | numbers)

    def advance(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and labels."""
        key = state << 8 | byte
        to = self.next.get(key)
        if (to < 0).any():
            self._build(np.unique(key[to < 0]))
            to = self.next.get(key)
        return to >> 32, self.label[to & 0xFFFFFFFF]

    def labels(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """For each byte of the pieces ``data[starts:starts+lens]`` the token that ends there in the encoding up to there."""
        out = np.zeros(len(data), np.int32)
        order = np.argsort(-lens, kind="stable")
        starts, lens = starts[order], lens[order]
        state = np.full(len(starts), self.start, np.int64)
        for j in range(int(lens[0]) if len(lens) else 0):
            n = int(np.searchsorted(-lens, -j, side="left"))  # pieces of more than j bytes
            at = starts[:n] + j
            state, out[at] = self.advance(state[:n], data[at].astype(np.int64))
        return out

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the number of each piece's."""
        if self.count > MAX_STATES:
            self.reset()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lens) - lens
        short = (lens <= BLOCK) & (lens > 0)
        label = self.labels(data, starts[short], lens[short])
        last = np.zeros(len(data), bool)  # where tokens end
        low, at = starts[short], starts[short] + lens[short]
        while len(at):
            last[at - 1] = True
            at = at - self.merges.lens[label[at - 1]]
            on = at > low
            low, at = low[on], at[on]
        for i in np.flatnonzero(lens > BLOCK):
            at = int(starts[i])
            for token in self.stream(pieces[i]):
                at += int(self.merges.lens[token])
                label[at - 1], last[at - 1] = token, True
        ends = np.concatenate([[0], np.cumsum(last)])
        return label[last], ends[starts + lens] - ends[starts]

    def stream(self, piece: bytes) -> Iterator[int]:
        """Ids of one piece, however long, sent as soon as a block later all live places agree on them."""
        lens = self.merges.lens
        memo: dict[int, tuple[int, int]] = {}
        state, label, base = self.start, [], 0  # label: of the bytes from base on
        for i, byte in enumerate(piece):
            key = state << 8 | byte
            if key not in memo:
                if self.count > MAX_STATES and state != self.start:
                    state, memo = self._restarted(state), {}
                    key = state << 8 | byte
                to, sent = self.advance(np.array([state]), np.array([byte], np.int64))
                memo[key] = int(to[0]), int(sent[0])
            state, sent = memo[key]
            label.append(sent)
            if len(label) % BLOCK == 0:
                # the encodings up to all live places go back to one place, up to which they are the same
                places = {i + 1 - int(self.merges.depth[node]) for node, _ in self._entries(state)}
                while len(places) > 1:
                    top = max(places)
                    places.remove(top)
                    places.add(top - int(lens[label[top - base - 1]]) if top > base else base)
                to = places.pop()
                yield from self._path(label[: to - base])
                label, base = label[to - base :], to
        yield from self._path(label)

    def _path(self, label: list[int]) -> list[int]:
        out, at = [], len(label)
        while at > 0:
            out.append(label[at - 1])
            at -= int(self.merges.lens[label[at - 1]])
        return out[::-1]

    def _entries(self, state: int) -> list[tuple[int, int]]:
        out = []
        while state > 0:
            out.append((int(self.node[state]), int(self.before[state])))
            state = int(self.parent[state])
        return out[::-1]

    def _restarted(self, state: int) -> int:
        """Drop the tables, and number ``state`` anew."""
        entries = self._entries(state)
        self.reset()
        at = np.zeros(1, np.int64)
        for node, before in entries:
            at = self._append(at, np.array([node], np.int64), np.array([before], np.int64))
        return int(at[0])

    def encode(self, piece: bytes) -> list[int]:
        return self.encode_all([piece])[0].tolist()


#: Bytes of visible ASCII, and lead bytes that no character of white space has.
_SEEN = np.zeros(256, bool)
_SEEN[0x21:0x7F] = True
_SEEN_NEXT = _SEEN.copy()
_SEEN_NEXT[0xC3:0xF5] = True
_SEEN_NEXT[[0xE1, 0xE2, 0xE3]] = False


class Encoder:
    """Texts to ids: parts between single spaces, each by pattern and transducer; parts seen lately are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, merges: Merges | None = None) -> None:
        self.machine = Transducer(ranks, merges)
        self.pieces = regex.compile(pattern).findall
        self.by_space = pattern in SPACE_PATTERNS
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.decimal = pa.array([str(i) for i in range(len(self.machine.merges.lens))], pa.string())

    def parts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where parts begin: texts, and single spaces between visible characters."""
        begins = np.zeros(len(raw), bool)
        begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        if self.by_space and len(raw) > 2:
            at = np.flatnonzero(raw == 0x20)
            at = at[(at > 0) & (at < len(raw) - 1)]
            before, before2, before3 = raw[at - 1], raw[at - 2], raw[np.maximum(at - 3, 0)]
            # a character that ends before the space: not U+0085 or U+00A0, nor one of three bytes among which white space is
            wide = (before >= 0x80) & (before2 != 0xC2) & ((before3 < 0xE1) | (before3 > 0xE3))
            at = at[(_SEEN[before] | wide) & _SEEN_NEXT[raw[at + 1]]]
            begins[at] = True
        return np.flatnonzero(begins)

    def _new(self, parts: list[bytes]) -> list[bytes]:
        number: dict[str, int] = {}
        by_part = [[number.setdefault(p, len(number)) for p in self.pieces(part.decode())] for part in parts]
        ids, many = self.machine.encode_all([p.encode() for p in number])
        ends = np.cumsum(many)
        data = ids.astype(np.int32).tobytes()
        cut = list(zip((4 * (ends - many)).tolist(), (4 * ends).tolist(), strict=True))
        return [b"".join([data[cut[k][0] : cut[k][1]] for k in ks]) if len(ks) != 1 else data[cut[ks[0]][0] : cut[ks[0]][1]] for ks in by_part]

    def look_up(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part as 32-bit integers; when the memo is full, what was not asked for since the last time is forgotten."""
        if len(self.memo) > MAX_CACHE:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        found = list(map(memo.get, parts))
        ask = []
        for i, x in enumerate(found):
            if x is None:
                x = old.get(parts[i])
                if x is None:
                    ask.append(i)
                else:
                    found[i] = memo[parts[i]] = x
        for a in range(0, len(ask), NEW):
            some = ask[a : a + NEW]
            for i, x in zip(some, self._new([parts[i] for i in some]), strict=True):
                found[i] = x
                if len(parts[i]) < 64:  # longer ones are rare, and large to keep
                    memo[parts[i]] = x
        return found

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all texts, the number before each text, and each text's decimal ids joined by commas."""
        raw, offsets = buffers(texts)
        starts = self.parts(raw, offsets)
        n = len(starts)
        bounds = np.append(starts, len(raw))
        cut = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        found = self.look_up(cut.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), np.int32)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(lens) - lens
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begin, len(flat)).astype(np.int32)), self.decimal.take(pa.array(flat))), ",")
        index = cut.indices.to_numpy()
        many = lens[index]
        ends = np.cumsum(many)
        ids = flat[np.arange(int(ends[-1]) if n else 0) + np.repeat(begin[index] - ends + many, many)]
        first = np.searchsorted(starts, offsets)  # part with which each text begins
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), words.cast(pa.large_string()).take(cut.indices)), pa.scalar(",", pa.large_string()))
        return ids, np.append(0, ends)[first], joined

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        return self.batch(pa.array([text], pa.string()))[2][0].as_py()


class Utf8Stream:
    """Incremental UTF-8: a state machine over the bytes at the end of each block tells how many are an unfinished character."""

    #: Bytes still due after a lead byte, by its value.
    DUE = [1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0 for b in range(256)]

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, block: bytes) -> str:
        block = self.pending + block
        due, start = 0, len(block)
        for i in range(max(0, len(block) - 3), len(block)):
            byte = block[i]
            if due and byte & 0xC0 == 0x80:
                due -= 1
            else:
                due, start = self.DUE[byte], i
        cut = start if due else len(block)
        self.pending = block[cut:]
        return block[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


class Decoder:
    """Ids to bytes and text, block by block."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def to_bytes(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lens)):
            raise ValueError("an id is not in the vocabulary")
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        return self.data[np.arange(ends[-1] if len(ids) else 0) + np.repeat(self.begin[ids] - ends + lens, lens)].tobytes()

    def stream(self, ids: np.ndarray, block: int = 1 << 16) -> Iterator[tuple[bytes, str]]:
        """Bytes and the text of all characters finished so far."""
        utf8 = Utf8Stream()
        for at in range(0, len(ids), block):
            data = self.to_bytes(ids[at : at + block])
            yield data, utf8.feed(data)
        if last := utf8.finish():
            yield b"", last


def tools(tables, digest: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    """The coders of a rank file; a worker makes them once."""

    def make() -> tuple[Encoder, Decoder]:
        ranks, merges = tables.value
        return Encoder(ranks, pattern, merges), Decoder(ranks)

    return kept(__name__, (digest, pattern), make)


def _tables(df: DataFrame, ranks_path: str) -> tuple:
    """Broadcast of a vocabulary and what follows from it (a few MB, bounded by the ranks that :class:`Merges` admits), and the file's digest."""
    with open(ranks_path, "rb") as f:
        raw = f.read()
    ranks = parse_ranks(raw)
    return df.sparkSession.sparkContext.broadcast((ranks, Merges(ranks))), hashlib.sha1(raw).digest()


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each text as little-endian unsigned 32-bit integers."""

    def rows(ids: np.ndarray, bounds: np.ndarray, *_) -> list[pa.Array]:
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(4 * bounds.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
        return [made.cast(pa.binary())]

    return _each(docs, ranks_path, pattern, id_col, text_col, rows, "doc_id long, ids binary")


def decoded(ids: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of what :func:`encoded` gives."""
    ranks = ids.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(ranks.value)
        for b in text_slices(batches, "ids"):
            texts = ["".join(t for _, t in dec.stream(np.frombuffer(x or b"", "<u4").astype(np.int64))) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(ids, id=id_col, ids=ids_col).mapInArrow(thrifty(run), "doc_id long, text string")


def _digests(ids: np.ndarray, bounds: np.ndarray, joined: pa.Array, texts: pa.Array, dec: Decoder) -> list[pa.Array]:
    raw, at = buffers(joined)
    view, sent, back = memoryview(raw), [], []
    characters = pc.utf8_length(texts).fill_null(0).to_pylist()
    for i, (a, z) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
        sent.append(hashlib.sha256(view[at[i] : at[i + 1]]).hexdigest())
        data, chars = hashlib.sha256(), 0
        for block, got in dec.stream(ids[a:z]):
            data.update(block)
            chars += len(got)
        if chars != characters[i]:
            raise ValueError("the decoded text has another length")
        back.append(data.hexdigest())
    return [pa.array(np.diff(bounds)), pa.array(sent, pa.string()), pa.array(back, pa.string())]


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, decoded again, and both digested."""
    return _each(docs, ranks_path, pattern, id_col, text_col, _digests, SCHEMA)


def _each(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, rows, schema: str) -> DataFrame:
    tables, digest = _tables(docs, ranks_path)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        enc, dec = tools(tables, digest, pattern)
        for b in text_slices(batches, "text", SLICE):
            texts = b.column("text")
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), *rows(*enc.batch(texts), texts, dec)], names)

    return pick(docs, id=id_col, text=text_col).mapInArrow(thrifty(run), schema)
