"""Byte-pair encoding and decoding, exactly as a byte-level BPE tokenizer file prescribes.

Encoding of a pre-token. The encoding of a text's prefix ends in one certain token. An automaton over the vocabulary
yields, for each prefix, the tokens that are its suffixes; the one that is compatible with the last token of the
prefix it leaves is stored, and back-pointers from the whole pre-token give the ids. Two tokens are compatible if
merging their bytes yields just these two, which is tested on the merge tree and kept.

Pre-tokens are found for a whole Arrow batch at once on an array of code points and encoded once for each distinct one;
texts with the special token's string go through the regular expression.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BASE, BASE_INV, mix, powers, slices

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_CHARS = 2 << 20
CACHE = 150_000  # pre-tokens kept by a worker


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str, library: bool = False):
        """library: pre-tokens are encoded by the tiktoken library instead, where ids follow the merges' order."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.id_of = {to_bytes(s): i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
            self.id_of.pop(s.encode(), None)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = {}  # token -> rank of the merge that makes it
        for k, m in enumerate(model["merges"]):
            a, b = (to_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            pair, made = (self.id_of[a], self.id_of[b]), self.id_of[a + b]
            self.rank[pair] = k
            if made not in self.parts:
                self.parts[made], self.order[made] = pair, k
        self.suffixes = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            if len(b) == 1 or i in self.parts:
                self.suffixes.add_word(b.decode("latin-1"), (i, len(b)))
        self.suffixes.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, bytes] = {}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.encode_piece = self.encode_bytes
        made = [i for i, _ in sorted(self.order.items(), key=lambda x: x[1])]
        if library and made == sorted(made) and (not made or made[0] > max(i for b, i in self.id_of.items() if len(b) == 1)):
            import tiktoken

            ranks = {b: i for b, i in self.id_of.items() if len(b) == 1 or i in self.parts}
            single = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
            self.encode_piece = lambda text: struct.pack(f"<{len(x := single(text))}I", *x)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves just the two.

        Walk down the inner edges of the two merge trees, undoing the later merge first; a pair of the two edges that
        merges before the undone one would have been merged, so the tokens could not stand side by side.
        """
        key = (left, right)
        got = self.fits.get(key)
        if got is None:
            got = self.fits[key] = self._compatible(left, right)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        limit = len(self.rank)  # rank of the merge undone last; a pair that merges before it wins
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = self.order.get(a, -1), self.order.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # At equal ranks the left one merges first, so the right one is undone first.
            if ra > rb:
                # The left token's last merge took its right part away from b; on a tie of ranks left goes first.
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1 if ra < 0 or ra <= rb else rb, self.parts[b][0]

    def encode_bytes(self, text: bytes) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit integers."""
        whole = self.id_of.get(text)
        if whole is not None and (len(text) == 1 or whole in self.parts):
            return whole.to_bytes(4, "little")
        last, back = [-1] * len(text), [0] * len(text)
        fits, ends = self.fits, -1
        for end, (token, size) in self.suffixes.iter(text.decode("latin-1")):
            if end == ends:
                continue  # this prefix has its token
            before = end - size
            if before >= 0:
                left = last[before]
                if left < 0:
                    continue
                ok = fits.get((left, token))
                if ok is None:
                    ok = self.compatible(left, token)
                if not ok:
                    continue
            last[end], back[end], ends = token, before, end
        out = []
        at = len(text) - 1
        while at >= 0:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def encode_pretoken(self, text: str) -> bytes:
        got = self.known.get(text)
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
                self.fits.clear()
            got = self.known[text] = self.encode_piece(text.encode())
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text, by the regular expression; the special token's string becomes its id."""
        if not self.special:
            return b"".join(map(self.encode_pretoken, _pattern.findall(text)))
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += map(self.encode_pretoken, _pattern.findall(text[at : m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        out += map(self.encode_pretoken, _pattern.findall(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not valid UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_pattern = regex.compile(PATTERN)
_codecs: dict[tuple[str, bool], Codec] = {}
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The endings that the pattern takes after an apostrophe, as code points.
SINGLES = [ord(x) for x in "sdmt"]
PAIRS = [ord(a) << 21 | ord(b) for a, b in ("ll", "ve", "re")]
_kinds: np.ndarray | None = None


def codec(path: str, library: bool = False) -> Codec:
    """The codec of a tokenizer file, read once by each worker."""
    if (path, library) not in _codecs:
        _codecs[path, library] = Codec(path, library)
    return _codecs[path, library]


def kinds() -> np.ndarray:
    """The pattern's class of every code point."""
    global _kinds
    if _kinds is None:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, what in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            table[[ord(c) for c in regex.findall(what, every)]] = kind
        _kinds = table
    return _kinds


def _pretoken_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where pre-tokens start in texts one after another; first: where texts start."""
    n = len(cp)
    kind = kinds()[cp]
    space = kind == SPACE
    fresh = np.zeros(n + 1, bool)  # a text starts here
    fresh[first] = True
    start = np.zeros(n, bool)
    changes = np.empty(n, bool)
    changes[0] = True
    np.not_equal(kind[1:], kind[:-1], out=changes[1:])
    changes |= fresh[:n]
    # A run of white space starts a pre-token; its last character another, unless the text ends with the run.
    start |= space & changes
    ends = np.zeros(n, bool)
    ends[:-1] = space[:-1] & ~space[1:] & ~fresh[1:n]
    start |= ends
    # Other runs start one, unless a blank of the same text stands before them and belongs to them.
    blank = np.zeros(n, bool)
    blank[1:] = (cp[:-1] == 0x20) & ~fresh[1:n]
    start |= ~space & changes & ~blank
    # An apostrophe that starts a pre-token takes the ending after it; letters after that start another.
    at = np.flatnonzero((cp[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~fresh[1:n])
    if len(at):
        own = cp[at + 1]
        then = np.where((at + 2 < n) & ~fresh[np.minimum(at + 2, n)], cp[np.minimum(at + 2, n - 1)], 0)
        two = np.isin(own.astype(np.int64) << 21 | then, PAIRS)
        taken = np.where(np.isin(own, SINGLES), 1, np.where(two, 2, 0))
        at, taken = at[taken > 0], taken[taken > 0]
        start[at + 1] = False
        rest = at + 1 + taken
        rest = rest[(rest < n) & ~fresh[rest]]
        start[rest[kind[rest] == LETTER]] = True
    return np.flatnonzero(start)


def encode_batch(texts: list[str], c: Codec) -> list[bytes]:
    """Ids of each text."""
    out: list[bytes | None] = [None] * len(texts)
    plain = []
    for i, t in enumerate(texts):
        if not t:
            out[i] = b""
        elif any(s in t for s in c.special):
            out[i] = c.encode(t)
        else:
            plain.append(i)
    at = 0
    while at < len(plain):
        some, chars = [], 0
        while at < len(plain) and (not some or chars + len(texts[plain[at]]) <= CHUNK_CHARS):
            some.append(plain[at])
            chars += len(texts[plain[at]])
            at += 1
        _encode_plain([texts[i] for i in some], some, out, c)
    return out


def _encode_plain(texts: list[str], place: list[int], out: list, c: Codec) -> None:
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(cp)
    first = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) for t in texts[:-1]], out=first[1:])
    start = _pretoken_starts(cp, first)
    end = np.append(start[1:], n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(cp.astype(np.uint64), 11) * powers(BASE, n)[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * powers(BASE_INV, n)[start])
    del sums
    _, lead, which = np.unique(h, return_index=True, return_inverse=True)
    size = end - start
    # Equal hashes are checked to be equal strings; else the whole run takes the plain way.
    shift = np.repeat(start[lead][which] - start, size) + np.arange(n)
    if not (np.array_equal(size[lead][which], size) and np.array_equal(cp[shift], cp)):
        for i, t in zip(place, texts, strict=True):
            out[i] = c.encode(t)
        return
    del shift
    ids = [c.encode_pretoken(joined[a:b]) for a, b in zip(start[lead].tolist(), end[lead].tolist(), strict=True)]
    # All pre-tokens' ids, gathered from the distinct ones.
    count = np.array([len(x) for x in ids], np.int64) >> 2
    pool = np.frombuffer(b"".join(ids), "<u4")
    begin = np.cumsum(count) - count
    many = count[which]
    to = np.cumsum(many)
    flat = pool[np.repeat(begin[which] - (to - many), many) + np.arange(to[-1])]
    cut = np.append((to - many)[np.searchsorted(start, first)], to[-1])
    for k, i in enumerate(place):
        out[i] = flat[cut[k] : cut[k + 1]].tobytes()


def encode_texts(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns `keep` of docs, the text's ids (binary, little-endian unsigned 32-bit) and the text decoded from them.

    Null text: empty. Very long texts are encoded whole. Empty table: no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for part in slices(b):
                ids = encode_batch([t or "" for t in part.column(len(keep)).to_pylist()], c)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.string())], names=[*names, "ids", "decoded"])

    names = [f"_k{i}" for i in range(len(keep))]
    fields = [f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(names, keep, strict=True)]
    out = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, names, strict=True)), "text").mapInArrow(run, ", ".join([*fields, "ids binary, decoded string"]))
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, names, strict=True)), "ids", "decoded")
