"""Byte-level BPE encoding and decoding.

Every match of the split pattern is encoded by itself.  A segment tree over its byte positions
keeps, in each node, the least (rank, position) of the pairs below, so its root is the leftmost pair
of least rank.  A merge changes three leaves (the pair, its dead right half, the live neighbour on the
left), each by one walk to the root.  Short pieces of one padded length are merged side by side, a
numpy row each; long ones one at a time.  A piece that is itself a token gets that token.

Nulls and empty texts have no ids; an empty table gives an empty result.  Repeated rows give repeated
rows.  Other columns pass through by ``encode_texts`` if named, except that the columns it makes
replace columns of those names.  The rank file is read by the driver and broadcast: its size is that of the
vocabulary, whatever the input.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from strandline.llm._common import map_texts

#: Pieces of more bytes are merged one at a time.
LONG = 256
#: Cells of a block of pieces that are merged side by side.
BLOCK = 1 << 19
#: Pieces remembered between texts.
REMEMBERED = 200_000
_NONE = np.int64(1) << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern, self.cache = ranks, regex.compile(pattern), {}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()] or [0], np.int64)
        self.two = np.full((256, 256), _NONE)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.two[token[0], token[1]] = rank
        size = max(ranks.values()) + 1
        self.length, self.start = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        by_rank = sorted((r, t) for t, r in ranks.items())
        self.start[1:] = np.cumsum(self.length)[:-1]
        self.flat = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)

    # -- merging -----------------------------------------------------------------------------

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 24 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
        if not len(self.pair_keys):
            return np.full(len(key), _NONE)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge_block(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian uint32) of pieces of at most ``width`` bytes, a power of two."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        col = np.arange(width)
        live = col < size[:, None]
        token = np.where(live, self.byte[raw], -1)
        right = np.broadcast_to(col + 1, (n, width)).copy()
        left = np.broadcast_to(col - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE)
        rank = np.where(col[:-1] + 1 < size[:, None], self.two[raw[:, :-1], raw[:, 1:]], _NONE)
        tree[:, width : 2 * width - 1] = np.where(rank < _NONE, rank * width + col[:-1], _NONE)
        level = width
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            best = tree[rows, 1]
            pos, merged = best % width, best // width
            dead = right[rows, pos]
            after = right[rows, dead]
            token[rows, pos] = merged
            token[rows, dead] = -1
            right[rows, pos] = after
            has_after = after < size[rows]
            left[rows[has_after], after[has_after]] = pos[has_after]
            before = left[rows, pos]
            has_before = before >= 0
            r = np.full(len(rows), _NONE)
            r[has_after] = self._rank_of(merged[has_after], token[rows[has_after], after[has_after]])
            self._point(tree, rows, pos, np.where(r < _NONE, r * width + pos, _NONE), width)
            self._point(tree, rows, dead, np.full(len(rows), _NONE), width)
            if has_before.any():
                rb, b = rows[has_before], before[has_before]
                r = self._rank_of(token[rb, b], merged[has_before])
                self._point(tree, rb, b, np.where(r < _NONE, r * width + b, _NONE), width)
            rows = rows[tree[rows, 1] < _NONE]
        keep = token >= 0
        flat = token[keep].astype("<u4").tobytes()
        ends = np.cumsum(keep.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _point(tree: np.ndarray, rows: np.ndarray, pos: np.ndarray, value: np.ndarray, width: int) -> None:
        node = pos + width
        tree[rows, node] = value
        while width > 1:
            value = np.minimum(value, tree[rows, node ^ 1])
            node = node >> 1
            tree[rows, node] = value
            width >>= 1

    def merge_long(self, piece: bytes) -> bytes:
        """The same tree for one piece of any length."""
        n, width = len(piece), 1
        while width < n:
            width *= 2
        none, pairs = int(_NONE), self.pairs
        token, right, left = self.byte[np.frombuffer(piece, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        leaves = np.full(width, _NONE)
        raw = np.frombuffer(piece, np.uint8)
        rank = self.two[raw[:-1], raw[1:]]
        leaves[: n - 1] = np.where(rank < _NONE, rank * width + np.arange(n - 1), _NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none, *np.concatenate(levels[::-1]).tolist()]

        def point(at: int, value: int) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    return
                tree[node] = value

        while tree[1] < none:
            merged, pos = divmod(tree[1], width)
            dead = right[pos]
            after = right[dead]
            token[pos], token[dead], right[pos] = merged, -1, after
            r = None
            if after < n:
                left[after] = pos
                r = pairs.get(merged << 24 | token[after])
            point(dead, none)
            point(pos, none if r is None else r * width + pos)
            before = left[pos]
            if before >= 0:
                r = pairs.get(token[before] << 24 | merged)
                point(before, none if r is None else r * width + before)
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def _learn(self, pieces: Iterable[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.cache[piece] = self.merge_long(raw)
            else:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, found in by_width.items():
            step = max(1, BLOCK // width)
            for at in range(0, len(found), step):
                part = found[at : at + step]
                self.cache.update(zip([p for p, _ in part], self.merge_block([r for _, r in part], width), strict=True))

    # -- texts -------------------------------------------------------------------------------

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.cache) > REMEMBERED:
            self.cache.clear()
        cache = self.cache
        self._learn({p for pieces in split for p in pieces if p not in cache})
        return [b"".join(map(cache.__getitem__, pieces)) for pieces in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian uint32 ids stand for."""
        out, all_ids = [], np.frombuffer(ids, "<u4")
        for at in range(0, len(all_ids), 1 << 16):
            part = all_ids[at : at + (1 << 16)]
            n = self.length[part]
            ends = np.cumsum(n)
            index = np.repeat(self.start[part] - ends + n, n) + np.arange(ends[-1])
            out.append(self.flat[index].tobytes())
        return b"".join(out)


_made: dict[str, ByteBpe] = {}


def _tokenizer(raw: bytes, pattern: str) -> ByteBpe:
    """One per worker process and vocabulary."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, pattern)
    return _made[key]


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """``keep`` columns, ids (binary, little-endian uint32; null unless ``with_ids``), n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    def start() -> Callable:
        bpe = _tokenizer(ranks.value, pattern)

        def encode(texts: list) -> list[list]:
            ids = bpe.encode_batch(texts)
            return [ids if with_ids else [None] * len(ids), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]]

        return encode

    return map_texts(docs, text_col, keep, {"ids": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, start, 128)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` by the multilingual rank file."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
