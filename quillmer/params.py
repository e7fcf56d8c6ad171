"""Sketching parameters and the rules that tie them together."""

from __future__ import annotations

import math
import re
import warnings
from dataclasses import asdict, dataclass, replace

NUCLEOTIDES = "ACGT"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
#: Printable ASCII without the space.
TEXT = "".join(map(chr, range(33, 127)))

_SIZE = re.compile(r"(\d+(?:\.\d+)?)([kKmMgGtT]?)")


def parse_size(text: str | int) -> int:
    """``"10k"`` -> 10000; units of 10**3, 10**6, 10**9, 10**12.  The result must be whole and the number written whole."""
    if isinstance(text, int):
        return text
    found = _SIZE.fullmatch(text.strip())
    if not found or "." in found[1]:
        raise ValueError(f"not a size: {text!r}")
    return int(found[1]) * 1000 ** (" kmgt".index(found[2].lower() or " "))


@dataclass(frozen=True)
class SketchParams:
    kmer: int = 21
    sketch_size: int = 1000
    alphabet: str = NUCLEOTIDES
    canonical: bool = True
    preserve_case: bool = False
    seed: int = 42
    #: ``murmur3`` or ``md5_60`` (the first 60 bits of MD5, which SQL engines have too).
    hash_fn: str = "murmur3"
    min_copies: int = 1
    reads: bool = False
    counts: bool = False
    genome_size: int | None = None
    target_coverage: float | None = None
    #: One sketch for each file rather than for each record.
    concatenated: bool = True
    warning: float = 0.01

    def __post_init__(self) -> None:
        if not 1 <= self.kmer <= 32:
            raise ValueError("k-mer size must be from 1 to 32")
        if self.sketch_size < 1 or self.min_copies < 1:
            raise ValueError("sketch size and minimum copies must be positive")
        if self.hash_fn not in ("murmur3", "md5_60"):
            raise ValueError(f"unknown hash function {self.hash_fn!r}")
        if not self.alphabet.isascii() or not self.alphabet:
            raise ValueError("the alphabet must be ASCII and not empty")
        if self.reads and not self.concatenated:
            raise ValueError("read sets can't be sketched record by record")
        letters = self.alphabet if self.preserve_case else self.alphabet.upper()
        object.__setattr__(self, "alphabet", "".join(sorted(set(letters))))

    @classmethod
    def of(cls, *, protein: bool = False, text: bool = False, memory_bound: str | int | None = None, **given) -> SketchParams:
        """Parameters with the implications of the options applied.

        ``protein`` and ``text`` set alphabet and strandedness, protein also k 9.  ``min_copies``, ``genome_size``,
        ``target_coverage`` and ``memory_bound`` are for read sets, which keep counts.  ``memory_bound`` asks to drop
        k-mers seen once; that is done exactly.
        """
        if protein and text:
            raise ValueError("protein and text exclude each other")
        if protein or text:
            given = {"alphabet": AMINO_ACIDS if protein else TEXT, "canonical": False, "kmer": 9 if protein else 21} | given
            given["canonical"] = False
        if memory_bound is not None:
            if given.get("min_copies", 1) != 1:
                raise ValueError("a memory bound and minimum copies exclude each other")
            parse_size(memory_bound)
            given["min_copies"] = 2
        if given.get("genome_size") is not None:
            given["genome_size"] = parse_size(given["genome_size"])
        if given.get("min_copies", 1) > 1 or given.get("genome_size") or given.get("target_coverage"):
            given["reads"] = True
        if given.get("reads"):
            given["counts"] = True
        return cls(**given)

    @property
    def kmer_space(self) -> float:
        return float(len(self.alphabet)) ** self.kmer

    @property
    def use64(self) -> bool:
        return self.kmer_space > 2.0**32

    @property
    def hash_bits(self) -> int:
        return 60 if self.hash_fn == "md5_60" else 64 if self.use64 else 32

    @property
    def hash_offset(self) -> float:
        """What to add to a stored hash for its unsigned value: 64-bit hashes are stored with the top bit flipped, so that they sort as longs."""
        return 2.0**63 if self.hash_bits == 64 else 0.0

    @property
    def max_safe_length(self) -> float:
        """Longest sequence in which a given random k-mer is found with probability ``warning`` at most."""
        return self.warning * self.kmer_space / (1 - self.warning)

    def random_kmer_chance(self, length: float) -> float:
        return length / (length + self.kmer_space)

    def min_kmer_size(self, length: float) -> int:
        return math.ceil(math.log(length * (1 - self.warning) / self.warning) / math.log(len(self.alphabet)))

    def to_dict(self) -> dict:
        return asdict(self)

    def accepts(self, other: SketchParams, allow_smaller: bool = False, containment: bool = False) -> str | None:
        """Why sketches made with ``other`` can't be compared with ours; None if they can."""
        for name, label in (("alphabet", "alphabet"), ("seed", "seed"), ("kmer", "k-mer size"), ("canonical", "strandedness"), ("preserve_case", "case"), ("hash_fn", "hash function")):
            if getattr(self, name) != getattr(other, name):
                return f"its {label} differs ({getattr(other, name)} instead of {getattr(self, name)})"
        if other.sketch_size < self.sketch_size and not (allow_smaller or containment):
            return f"its sketches are smaller ({other.sketch_size} instead of {self.sketch_size})"
        if other.sketch_size > self.sketch_size:
            warnings.warn(f"sketches of {other.sketch_size} hashes are reduced to {self.sketch_size}", stacklevel=3)
        return None

    def with_(self, **changes) -> SketchParams:
        return replace(self, **changes)
