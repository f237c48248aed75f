"""Problem 8: encoding of a corpus with a public byte-level BPE tokenizer.

For every byte prefix of a pre-token exactly one token can be the last one of its
encoding.  That token is stored per prefix: an append only adds prefixes, and
after an edit only the prefixes from the edited byte on are computed again.  A
candidate is valid if it and the last token of what stands before it are not
merged otherwise; whether two tokens may stand side by side is found by undoing
their merges, the latest first.

Texts are cut into pre-tokens first.  Workers keep the prefixes and pre-tokens
they have met in tables of bounded size; what no longer fits is computed anew.
"""

from __future__ import annotations

import base64
import gc
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tarnloom.functions.worker import kept

#: Pre-tokens, prefixes and pairs of tokens that a worker remembers of each (about
#: 200 MB together).
REMEMBERED = 500_000
#: Bytes of a pre-token whose prefixes are remembered.
SHORT = 64
#: Fixed value: the pattern that cuts texts for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters by which this kind of vocabulary writes bytes: printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Byte-level BPE by last tokens of prefixes."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = ids
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(merges):
            t = ids.get(a + b)
            if t is None or t in self.halves:
                continue
            self.halves[t] = (ids[a], ids[b])
            self.rank[t] = i
            self.joined[ids[a], ids[b]] = t
        self.usable = {token: i for token, i in ids.items() if len(token) == 1 or i in self.halves}
        # by the last three bytes, the lengths that tokens can have, longest first
        by_tail: dict[bytes, set[int]] = {}
        for token in self.usable:
            if len(token) > 2:
                by_tail.setdefault(token[-3:], set()).add(len(token))
        self.tails = {tail: (*sorted(n, reverse=True), 2, 1) for tail, n in by_tail.items()}
        self.side_by_side: dict[int, bool] = {}
        self.seen: dict[bytes, tuple] = {}
        self.size = {i: len(token) for token, i in ids.items()}

    @classmethod
    def from_json(cls, path: str) -> PrefixEncoder:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_letters()
        raw = lambda s: bytes(byte[c] for c in s)
        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls(ids, [(raw(a), raw(b)) for a, b in pairs])

    @classmethod
    def from_ranks(cls, path: str) -> PrefixEncoder:
        """From a file of base64 tokens with ranks: a token's halves are the two
        tokens that its bytes come down to with the merges before it."""
        with open(path, "rb") as f:
            ids = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        merges = []
        for token, i in sorted(ids.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            parts = [bytes([b]) for b in token]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda k: ids.get(parts[k] + parts[k + 1], i))
                if ids.get(parts[best] + parts[best + 1], i) >= i:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2:
                merges.append((parts[0], parts[1]))
        return cls(ids, merges)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` stays as it is when encoded: no merge
        across their border comes before a merge that made one of them."""
        halves, rank, joined = self.halves, self.rank, self.joined
        never = len(rank) + 1
        bound = never
        while True:
            t = joined.get((left, right))
            if t is not None and rank[t] < bound:
                return False
            # undo the later of the two last merges and look at the border again;
            # of equal ones the left one was made first
            of_left, of_right = rank.get(left, -1), rank.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                bound, left = of_left, halves[left][1]
            else:
                bound, right = of_right + 1, halves[right][0]

    def last_token(self, data: bytes, end: int, lasts: list[int]) -> int:
        """The last token of ``data[:end]``; ``lasts[i]`` is that of ``data[:i]``."""
        usable, near = self.usable, self.side_by_side
        for n in self.tails.get(data[end - 3 : end] if end > 2 else b"", (2, 1)):
            if n > end:
                continue
            t = usable.get(data[end - n : end])
            if t is None:
                continue
            if n == end:
                return t
            before = lasts[end - n]
            pair = before << 20 | t
            ok = near.get(pair)
            if ok is None:
                if len(near) > REMEMBERED:
                    near.clear()
                ok = near[pair] = self.may_follow(before, t)
            if ok:
                return t
        raise ValueError("a byte without a token")

    def prefixes(self, data: bytes, lasts: list[int] | None = None) -> list[int]:
        """Last tokens of all prefixes; ``lasts`` holds those already known."""
        lasts = lasts or [-1]
        for end in range(len(lasts), len(data) + 1):
            lasts.append(self.last_token(data, end, lasts))
        return lasts

    def tokens(self, data: bytes, lasts: list[int] | None = None) -> list[int]:
        if lasts is None:
            if len(data) <= SHORT:
                return self._remembered(data)
            lasts = self.prefixes(data)
        out, end = [], len(data)
        while end:
            out.append(lasts[end])
            end -= self.size[lasts[end]]
        return out[::-1]

    def _remembered(self, data: bytes) -> list[int]:
        """As ``tokens``, with one table of prefixes for all short pre-tokens; only
        prefixes that a candidate stands on are computed."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        if len(self.side_by_side) > REMEMBERED:
            self.side_by_side.clear()
        entry, out = self._entry(data), []
        while entry:
            out.append(entry[0])
            entry = entry[1]
        return out[::-1]

    def _entry(self, head: bytes) -> tuple:
        """The last token of ``head`` and the entry of what stands before it."""
        end = len(head)
        for n in self.tails.get(head[-3:], (2, 1)):
            if n > end:
                continue
            t = self.usable.get(head[-n:])
            if t is None:
                continue
            if n == end:
                return t, None
            rest = head[:-n]
            before = self.seen.get(rest)
            if before is None:
                before = self.seen[rest] = self._entry(rest)
            pair = before[0] << 20 | t
            ok = self.side_by_side.get(pair)
            if ok is None:
                ok = self.side_by_side[pair] = self.may_follow(before[0], t)
            if ok:
                return t, before
        raise ValueError("a byte without a token")


class Draft:
    """One pre-token under change: ``append`` and ``replace`` compute only the
    prefixes that the change reaches."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b"") -> None:
        self.encoder, self.data = encoder, data
        self.lasts = encoder.prefixes(data)

    def append(self, more: bytes) -> None:
        self.replace(len(self.data), len(self.data), more)

    def replace(self, start: int, end: int, new: bytes) -> None:
        self.data = self.data[:start] + new + self.data[end:]
        self.lasts = self.encoder.prefixes(self.data, self.lasts[: start + 1])

    def tokens(self) -> list[int]:
        return self.encoder.tokens(self.data, self.lasts)


def _loaded(path: str) -> tuple[PrefixEncoder, regex.Pattern, dict[str, list[int]]]:
    def make():
        read = PrefixEncoder.from_json if path.endswith(".json") else PrefixEncoder.from_ranks
        return read(path), regex.compile(PATTERN), {}

    return kept(("tokens", path), make)


def encode_text(text: str, path: str) -> list[int]:
    """The ids of one text, without special tokens."""
    encoder, cutter, known = _loaded(path)
    out: list[int] = []
    for piece in cutter.findall(text):
        got = known.get(piece)
        if got is None:
            if len(known) > REMEMBERED:
                known.clear()
            data = piece.encode("utf-8", "surrogatepass")
            whole = encoder.usable.get(data)  # a token is its own encoding
            got = known[piece] = [whole] if whole is not None else encoder.tokens(data)
        out += got
    return out


def encode(df: DataFrame, key: str = "doc_id", column: str = "text", path: str | None = None) -> DataFrame:
    """``(key, ids)`` for every row of ``df``: the token ids of ``column`` without
    special tokens, whose names in a text are ordinary text.  Null and empty
    texts give an empty list.  ``path``: the vocabulary file, on every executor."""
    path = path or default_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables hold no cycles, but many objects to walk over
        try:
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    p = b.slice(at, 500)
                    ids = [encode_text(t, path) if t else [] for t in p.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([p.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])
        finally:
            gc.enable()

    out = df.select(F.col(key), F.col(column)).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)
