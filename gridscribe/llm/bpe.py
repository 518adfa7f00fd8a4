"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import appending, chunks, table

#: Pieces encoded side by side have at most this many bytes; longer ones are encoded one by one.
WIDE = 64
#: Bytes of encoded pieces that a worker remembers within a partition; beyond it the memory starts anew.
REMEMBERED = 24 << 20
#: Bytes that a remembered piece takes besides its letters and ids.
PIECE_BYTES = 200


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter of each byte in vocabulary files: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)]


#: The vocabulary's pattern with its classes spelled out for code points up to U+00FF, where both give the same pieces.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LATIN_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ByteBpe:
    """Encodes and decodes as the vocabulary file says, without special treatment beyond its added tokens."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        to_byte = {c: b for b, c in enumerate(letters)}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: token.encode() for token, i in added.items()}
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.latin_pieces = re.compile(LATIN_PATTERN)
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        first = np.unique(keys, return_index=True)[1]  # of a repeated pair the first rank
        self.keys, self.ranks = keys[first], first.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.merged_list = self.merged.tolist()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.size = 0

    # -- one piece ------------------------------------------------------------------------------------------------
    def encode_one(self, piece: bytes) -> list[int]:
        """Leaf i of the tree holds rank * size + i of the pair that begins at i, so the root is the leftmost lowest rank."""
        sym = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(sym)
        size = 1 << max(1, (n - 1).bit_length())
        none, get = 1 << 60, self.rank_of.get
        tree = [none] * (2 * size)

        def leaf(i: int, j: int) -> int:
            rank = get((sym[i] << 32) | sym[j])
            return none if rank is None else rank * size + i

        for i in range(n - 1):
            tree[size + i] = leaf(i, i + 1)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                low = tree[2 * k] if tree[2 * k] < tree[2 * k + 1] else tree[2 * k + 1]
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            sym[i] = self.merged_list[rank]
            j = after[i]
            put(j, none)
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            put(i, leaf(i, after[i]) if after[i] < n else none)
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return out

    # -- many pieces side by side -----------------------------------------------------------------------------------
    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, size: int, none: int) -> np.ndarray:
        key = (a << 32) | b
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.ranks[k] * size + at, none)

    def encode_side_by_side(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The same tree for each of many pieces of up to `size` bytes: each step merges at every root at once."""
        m, none = len(pieces), 1 << 60
        lengths = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
        pos = np.arange(size, dtype=np.int64)
        sym = self.byte_id[raw].ravel()
        inside = pos < lengths[:, None]
        tree = np.full((m, 2 * size), none, np.int64)
        at = np.flatnonzero(inside[:, 1:].ravel())
        r, c = np.divmod(at, size - 1)
        at += r
        tree[r, size + c] = self._leaf(sym[at], sym[at + 1], c, size, none)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree = tree.ravel()
        after = np.tile(pos + 1, m)
        before = np.tile(pos - 1, m)
        alive = inside.ravel()

        def climb(base: np.ndarray, k: np.ndarray) -> None:
            """New minima above changed leaves k of the trees that begin at base."""
            for _ in range(size.bit_length() - 1):
                k = k >> 1
                left = base + 2 * k
                tree[base + k] = np.minimum(tree[left], tree[left + 1])

        rows = np.flatnonzero(tree[1 :: 2 * size] < none)
        while len(rows):
            base, first = rows * (2 * size), rows * size
            rank, i = np.divmod(tree[base + 1], size)
            here = first + i
            new = self.merged[rank]
            sym[here] = new
            j = after[here]
            alive[first + j] = False
            nxt = after[first + j]
            after[here] = nxt
            tree[base + size + j] = none
            tree[base + size + i] = none
            climb(base, size + j)
            has = np.flatnonzero(nxt < lengths[rows])
            there = first[has] + nxt[has]
            before[there] = i[has]
            tree[base[has] + size + i[has]] = self._leaf(new[has], sym[there], i[has], size, none)
            climb(base, size + i)
            prev = before[here]
            has = np.flatnonzero(prev >= 0)
            prev = prev[has]
            tree[base[has] + size + prev] = self._leaf(sym[first[has] + prev], new[has], prev, size, none)
            climb(base[has], size + prev)
            rows = rows[tree[base + 1] < none]
        sym, alive = sym.reshape(m, size), alive.reshape(m, size)
        ids = sym[alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def learn(self, pieces: set[str]) -> None:
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            n = len(raw)
            if n > WIDE:
                self.known[p] = np.array(self.encode_one(raw), "<u4").tobytes()
            else:
                names, raws = by_size.setdefault(2 if n < 3 else 1 << (n - 1).bit_length(), ([], []))
                names.append(p)
                raws.append(raw)
        for size, (names, raws) in by_size.items():
            for k in range(0, len(names), 1 << 14):
                self.known.update(zip(names[k : k + (1 << 14)], self.encode_side_by_side(raws[k : k + (1 << 14)], size)))

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null is an empty text."""
        cut: list[list[str] | list[tuple[int, list[str]]]] = []
        fresh: set[str] = set()
        for text in texts:
            find = (self.latin_pieces if text and is_latin(text) else self.pieces).findall
            if text and self.split_added and self.split_added.search(text):
                parts = [(self.added[x], []) if x in self.added else (-1, find(x)) for x in self.split_added.split(text) if x]
                fresh.update(*[p for i, p in parts if i < 0])
                cut.append(parts)
            else:
                cut.append(find(text) if text else [])
                fresh.update(cut[-1])
        if self.size > REMEMBERED:
            self.forget()
        fresh.difference_update(self.known)
        self.learn(fresh)
        self.size += sum(map(len, fresh)) + PIECE_BYTES * len(fresh)
        get = self.known.__getitem__
        out = []
        for parts in cut:
            if parts and isinstance(parts[0], tuple):
                out.append(b"".join(b"".join(map(get, p)) if i < 0 else i.to_bytes(4, "little") for i, p in parts))
            else:
                out.append(b"".join(map(get, parts)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; ids outside the vocabulary are skipped, bytes that are no UTF-8 become U+FFFD."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def _encoding(path: str, text_col: str, decoding: bool):
    def run(batches):
        bpe = tokenizer(path)
        try:
            for batch in batches:
                for part in chunks(batch, text_col):
                    ids = bpe.encode_texts(part.column(text_col).to_pylist())
                    more = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                    if decoding:
                        more.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                    yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *["_ids", "_n_tokens", "_decoded"][: len(more)]])
        finally:
            bpe.forget()

    return run


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with _ids (binary: little-endian unsigned 32-bit ids of the whole text) and _n_tokens (long).

    Null and empty texts have no ids. A text that names an added token gives that token's id there, as the library does. Each
    text is encoded by itself, so ties, repeated rows and empty tables need nothing special; a very long text is a slice of its own. Further columns stay, and columns
    named like the results are replaced. No shuffle; a worker holds one batch and a bounded memory of pieces, given back at the end of a partition.
    """
    return appending(docs.drop("_ids", "_n_tokens"), _encoding(path or vocabulary_path(), text_col, False), "_ids binary, _n_tokens bigint")


def round_trip(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass of one worker: docs with _ids, _n_tokens and _decoded, the text of these ids."""
    docs = docs.drop("_ids", "_n_tokens", "_decoded")
    return appending(docs, _encoding(path or vocabulary_path(), text_col, True), "_ids binary, _n_tokens bigint, _decoded string")


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "_ids") -> DataFrame:
    """encoded with _decoded: the text of its ids. Null ids give a null; ids outside the vocabulary are skipped, as the library does."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            for part in chunks(batch, ids_col):
                texts = [None if x is None else bpe.decode(x) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "_decoded"])

    return appending(encoded.drop("_decoded"), run, "_decoded string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = round_trip(docs)
    return rows.select("doc_id", F.col("_n_tokens").alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_decoded", 256).alias("decoded_sha256"))
