"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words.  A word goes when a window covering it also starts in a
document with a smaller id.  Hashing every window of the corpus would shuffle a row per word, so
windows are found in two exact steps:

1. With a difference cover D of the residues modulo v, any two positions i and j have a shift d < v
   with (i+d) mod v and (j+d) mod v both in D.  Hash only the ``window - v + 1`` words that start at
   cover positions: two equal windows always share such an anchor at an aligned place.
2. Windows that hold an anchor seen in two documents are extended: their full hash is dealt out,
   and all but those of the smallest document are marked.

Both steps settle what they can before the shuffle (``settle``): of a hash that several documents of a
stretch of input hold, only the smallest document goes on, as the others are decided.  So a window that
every document holds is one document's entries a stretch, and a reducer, which settles what it has
whenever it holds ``HELD`` entries, keeps one document of it.

Hashes have 64 bits.  Nulls: a null text has no words; a row with a null id neither removes nor
loses words.  Rows that repeat an id count as one document.  Texts shorter than a window lose
nothing.  An empty table gives an empty result.  Columns named in ``extra`` pass through, whatever their
names, except that the names this operator makes (``text``, ``n_words``, ``n_removed``, ``kept_sha256``)
replace columns of those names; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import Scratch, WordHasher, by_bucket, mix, packed, rows_of, windows, words_of

#: A perfect difference set for its modulus; every residue is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Anchors or windows in one bucket of a packed shuffle, about; this bounds a reducer's memory.
PER_BUCKET = 200_000
#: Anchors or windows of a stretch of input, which is settled and sent.
FLUSH = 500_000
#: Entries that a reducer holds before it settles them.
HELD = 500_000
#: Characters of texts after which a batch of results is sent.
OUT_CHARS = 8_000_000

_PACK = "bucket long, h binary, doc binary, pos binary"
_MARK = "bucket long, doc binary, pos binary"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The period and residues whose anchors keep at least half of the window's words."""
    period = max((v for v in COVERS if v <= window // 2 + 1), default=1)
    return period, COVERS.get(period, (0,))


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one document."""
    period, residues = cover_for(window)
    a = windows(h, window - period + 1)
    pos = np.flatnonzero(np.isin(np.arange(period), residues)[np.arange(len(a)) % period])
    return pos, a[pos]


def candidate_starts(n_words: int, shared: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold a shared anchor."""
    period, _ = cover_for(window)
    n = n_words - window + 1
    if n <= 0 or not len(shared):
        return np.empty(0, np.int64)
    at = np.zeros(n + period + 1, np.int64)
    np.add.at(at, np.maximum(shared - period + 1, 0), 1)
    np.add.at(at, np.minimum(shared + 1, n + period), -1)
    return np.flatnonzero(np.cumsum(at)[:n] > 0)


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows at these starts cover."""
    at = np.zeros(n_words + 1, np.int64)
    starts = np.unique(starts)
    np.add.at(at, starts, 1)
    np.add.at(at, starts + window, -1)
    return np.cumsum(at)[:n_words] > 0


def cut_text(text: str, gone: np.ndarray) -> str:
    """The text without the words that are gone and the blanks after them; what stays is unchanged."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    for (start, _), dead, nxt in zip(spans, gone, [*(s for s, _ in spans[1:]), len(raw)], strict=True):
        if dead:
            out.append(raw[at:start])
            at = nxt
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def settle(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, mark_all: bool) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of entries (hash, doc, pos): places (doc, pos) that are marked for sure, and entries that go on.

    ``mark_all``: all places of a hash in two documents are marked; one entry without a place (-1) stands
    for them from then on.  Else all but the smallest document's are marked, and its entries go on.
    """
    order = np.lexsort((doc, h))
    h, doc, pos = h[order], doc[order], pos[order]
    starts = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1] if len(h) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(h)])
    least = np.repeat(doc[starts], sizes)
    if not mark_all:
        hit = doc != least
        return (doc[hit], pos[hit]), (h[~hit], doc[~hit], pos[~hit])
    shared = doc[starts] != doc[starts + sizes - 1] if len(h) else np.empty(0, bool)
    known = np.zeros(len(h), bool)
    known[starts] = True
    shared |= np.logical_or.reduceat(pos < 0, starts) if len(h) else shared
    many = np.repeat(shared, sizes)
    hit = many & (pos >= 0)
    rep = many & known
    on = ~many | rep
    return (doc[hit], pos[hit]), (h[on], doc[on], np.where(rep, np.int32(-1), pos)[on])


class _Send:
    """Collects (hash, doc, pos) arrays; sends what isn't settled as packed rows, and marks in a row of their own."""

    def __init__(self, buckets: int, mark_all: bool) -> None:
        self.buckets, self.mark_all, self.h, self.doc, self.pos, self.n = buckets, mark_all, [], [], [], 0

    def add(self, h: np.ndarray, doc: int, pos: np.ndarray) -> None:
        if len(h):
            self.h.append(h)
            self.doc.append((doc, len(h)))
            self.pos.append(pos.astype(np.int32))
            self.n += len(h)

    def flush(self) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(self.h)
        doc = np.repeat([d for d, _ in self.doc], [n for _, n in self.doc]).astype(np.int64)
        pos = np.concatenate(self.pos)
        self.h, self.doc, self.pos, self.n = [], [], [], 0
        marks, on = settle(h, doc, pos, self.mark_all)
        schema = _schema(_PACK)
        yield packed((on[0] % np.uint64(self.buckets)).astype(np.int64), list(on), schema)
        for at in range(0, len(marks[0]), PER_BUCKET):
            part = [m[at : at + PER_BUCKET] for m in marks]
            lane = -1 - int(mix(h[at : at + 1])[0] % np.uint64(self.buckets))
            yield pa.RecordBatch.from_arrays([pa.array([lane]), pa.array([b""], pa.binary()), *[pa.array([m.tobytes()], pa.binary()) for m in part]], schema=schema)


def _schema(names: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))])


def _emit_anchors(window: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, send = WordHasher(), _Send(buckets, True)
        for batch in batches:
            for ids, texts in rows_of(batch):
                for doc, text in zip(ids, texts, strict=True):
                    pos, h = anchors(words.hashes(words_of(text)), window)
                    send.add(h, doc, pos)
                    if send.n >= FLUSH:
                        yield from send.flush()
        if send.n:
            yield from send.flush()

    return run


def _match(deal: int, mark_all: bool) -> Callable:
    """Per bucket of packed hashes: the places that are marked, dealt by document."""
    schema = _schema(_MARK)

    def marked(doc: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(doc), HELD):
            d, p = doc[at : at + HELD], pos[at : at + HELD]
            yield packed(d % deal, [d, p], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        bucket, size, settled = None, 0, 0

        def settled_entries() -> Iterator[pa.RecordBatch]:
            nonlocal size, settled
            marks, on = settle(*[np.concatenate(c) for c in held], mark_all)
            for into, c in zip(held, on, strict=True):
                into[:] = [c]
            size = settled = len(on[0])
            yield from marked(*marks)

        for batch in batches:
            buckets = batch.column(0).to_pylist()
            for i, b in enumerate(buckets):
                cells = [np.frombuffer(batch.column(c + 1)[i].as_buffer(), t) for c, t in enumerate((np.uint64, np.int64, np.int32))]
                if b < 0:
                    yield from marked(*cells[1:])
                    continue
                if b != bucket:
                    if size:
                        yield from settled_entries()
                    held, bucket, size, settled = [[], [], []], b, 0, 0
                for into, c in zip(held, cells, strict=True):
                    into.append(c)
                size += len(cells[0])
                # what goes on may be many different hashes, so wait until as many again have come
                if size >= max(HELD, 2 * settled):
                    yield from settled_entries()
        if size:
            yield from settled_entries()

    return run


def _with_marks(per_text: Callable, out: Callable) -> Callable:
    """Streams rows sorted by (bucket, kind): marks (kind 0) of a bucket come before its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, docs, pos, state = None, None, None, out()
        for batch in batches:
            for columns in rows_of(batch):
                for b, kind, md, mp, *row in zip(*columns, strict=True):
                    if b != bucket:
                        bucket, docs, pos = b, [], []
                    if kind == 0:
                        docs.append(np.frombuffer(md, np.int64))
                        pos.append(np.frombuffer(mp, np.int32))
                        continue
                    if isinstance(docs, list):
                        docs = np.concatenate([np.empty(0, np.int64), *docs])
                        pos = np.concatenate([np.empty(0, np.int32), *pos])
                        order = np.argsort(docs, kind="stable")
                        docs, pos = docs[order], pos[order]
                    doc = row[0]
                    if doc is None:
                        mine = np.empty(0, np.int32)
                    else:
                        mine = pos[np.searchsorted(docs, doc) : np.searchsorted(docs, doc, "right")]
                    per_text(state, mine.astype(np.int64), *row)
                    if state.full():
                        yield from state.ready(False)
                yield from state.ready(False)
        yield from state.ready(True)

    return run


class _Candidates:
    def __init__(self, buckets: int) -> None:
        self.words, self.send = WordHasher(), _Send(buckets, False)

    def full(self) -> bool:
        return self.send.n >= FLUSH

    def ready(self, last: bool) -> Iterator[pa.RecordBatch]:
        return self.send.flush() if self.send.n >= FLUSH or last and self.send.n else iter(())


class _Rows:
    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def full(self) -> bool:
        return self.size >= OUT_CHARS

    def ready(self, last: bool) -> Iterator[pa.RecordBatch]:
        if self.rows:
            rows, self.rows, self.size = self.rows, [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), self.schema.types, strict=True)], schema=self.schema)


def _union(docs: DataFrame, marks: DataFrame, deal: int) -> DataFrame:
    """Texts (doc_id, text, hidden columns) and their marks in one stream, dealt by document."""
    own = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    none = F.lit(None).cast("binary")
    texts = docs.select(F.pmod(own, F.lit(deal)).alias("bucket"), F.lit(1).alias("kind"), none.alias("md"), none.alias("mp"), *docs.columns)
    mark = marks.select("bucket", F.lit(0).alias("kind"), F.col("doc").alias("md"), F.col("pos").alias("mp"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    return by_bucket(texts.unionByName(mark), "kind")


#: The columns that ``dedup_substrings`` makes.
MADE = ("doc_id", "text", "n_words", "n_removed", "kept_sha256")


def dedup_substrings(docs: DataFrame, window: int = 13, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, text (what is kept, layout unchanged), n_words, n_removed, kept_sha256, and ``extra`` columns.

    ``kept_sha256`` is of the kept words joined by one blank.
    """
    spark = docs.sparkSession
    extra = [c for c in extra if c.lower() not in MADE]
    hidden = {c: f"__x{i}" for i, c in enumerate(extra)}
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[docs[f"`{c}`"].alias(h) for c, h in hidden.items()])
    scratch = Scratch(spark, "substring")
    n_rows, n_chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    buckets = 1 + n_chars // (12 * PER_BUCKET)  # an anchor for every 12 characters or more of prose
    deal = 1 + max(n_rows // 4_000, n_chars // 8_000_000)
    texts = docs.where("doc_id is not null").select("doc_id", "text")

    first = texts.mapInArrow(_emit_anchors(window, buckets), _PACK)
    shared = scratch.keep(by_bucket(first).mapInArrow(_match(deal, True), _MARK), "anchors")
    period, residues = cover_for(window)
    marked = shared.agg(F.coalesce(F.sum(F.octet_length("pos").cast("long")), F.lit(0))).first()[0] // 4
    found_buckets = 1 + marked * period // (len(residues) * PER_BUCKET)

    def extend(state: _Candidates, mine: np.ndarray, doc: int, text: str | None) -> None:
        if len(mine):
            h = state.words.hashes(words_of(text))
            starts = candidate_starts(len(h), mine, window)
            state.send.add(windows(h, window)[starts], doc, starts)

    found = _union(texts, shared, deal).mapInArrow(_with_marks(extend, lambda: _Candidates(found_buckets)), _PACK)
    removed = scratch.keep(by_bucket(found).mapInArrow(_match(deal, False), _MARK), "windows")
    scratch.drop(shared)

    from pyspark.sql.pandas.types import to_arrow_type

    made = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *[(h, to_arrow_type(docs.schema[h].dataType)) for h in hidden.values()]])

    def finish(state: _Rows, mine: np.ndarray, doc: int | None, text: str | None, *more: object) -> None:
        words, kept = words_of(text), text
        n, lost = len(words), 0
        if len(mine) and n:
            gone = covered(n, mine[mine <= n - window], window)
            lost = int(gone.sum())
            if lost:
                kept = cut_text(text, gone)
                words = [w for w, dead in zip(words, gone.tolist(), strict=True) if not dead]
        state.rows.append((doc, kept, n, lost, hashlib.sha256(b" ".join(words)).hexdigest(), *more))
        state.size += len(kept or "")

    ddl = ", ".join(["doc_id long, text string, n_words long, n_removed long, kept_sha256 string", *[f"`{h}` {docs.schema[h].dataType.simpleString()}" for h in hidden.values()]])
    out = _union(docs, removed, deal).mapInArrow(_with_marks(finish, lambda: _Rows(made)), ddl)
    return out.select(*MADE, *[F.col(h).alias(c) for c, h in hidden.items()])


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 13 words over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: DuckDB's answer for op10_substring_dedup.
OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), least AS (
  SELECT seq, min(doc_id) AS first_doc FROM win GROUP BY seq
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (seq) WHERE doc_id > first_doc
), lost AS (
  SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""
