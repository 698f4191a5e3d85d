"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Test items are cut into windows of ``window`` words (an item of fewer words is one window). Words
are the symbols of the search. Patterns of like length form a table set: a block of two words (of
one, where a pattern has only one) looks up how far the search may shift; where the shift is zero
the block's bucket gives the patterns that end so, which are then compared word by word, and the
words' bytes are compared at last. With windows of 13 words and no match the search looks at one
block in twelve.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import extended
from ._words import ALNUM, LOWER, chunks, hashes, spans

WINDOW = 13
#: Words of test items in one broadcast (some 0.4 KB each); more are searched in further passes.
BLOCK_WORDS = 250_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and non-ASCII characters."""
    (_, _, buf, off), = chunks(pa.array([text or ""]))
    buf = LOWER[buf]
    starts, ends, _ = spans(buf, off, ALNUM)
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _word_ids(words: list[bytes]) -> list[int]:
    buf = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return hashes(buf, ends - [len(w) for w in words], ends).tolist()


class WuManber:
    """Shift and suffix tables over patterns of words; ``find`` yields each occurrence."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set]):
        """``patterns``: words of a pattern to the items that have it. Words and lists of items are held once."""
        groups: dict[int, list] = defaultdict(list)
        longest = max(map(len, patterns), default=0)
        every = sorted({w for words in patterns for w in words})
        once = {w: w for w in every}
        ids_of = dict(zip(every, _word_ids(every))) if every else {}
        lists: dict[tuple, tuple] = {}
        for words, items in patterns.items():
            who = tuple(sorted(items))
            words = tuple(once[w] for w in words)
            groups[longest if len(words) == longest else 1 << (len(words).bit_length() - 1)].append((words, lists.setdefault(who, who)))
        self.tables = []
        for some in groups.values():
            m = min(len(w) for w, _ in some)
            b = min(2, m)
            shift: dict = {}
            bucket: dict = defaultdict(list)
            for words, items in some:
                ids = [ids_of[w] for w in words]
                for end in range(b - 1, m):
                    block = ids[end] if b == 1 else (ids[end - 1], ids[end])
                    shift[block] = min(shift.get(block, m), m - 1 - end)
                bucket[ids[m - 1] if b == 1 else (ids[m - 2], ids[m - 1])].append((words, items))
            self.tables.append((m, b, shift, dict(bucket)))

    def find(self, ids: list[int], word) -> Iterator[tuple[int, int, tuple]]:
        """``(first word, end, items)``. ``ids``: hashes of the text's words; ``word(k)``: the bytes of the k-th."""
        n = len(ids)
        for m, b, shift, bucket in self.tables:
            at, far = m - 1, m - b + 1
            while at < n:
                block = ids[at] if b == 1 else (ids[at - 1], ids[at])
                step = shift.get(block, far)
                if step:
                    at += step
                    continue
                first = at - m + 1
                for words, items in bucket.get(block, ()):
                    end = first + len(words)
                    if end <= n and all(word(first + k) == w for k, w in enumerate(words)):
                        yield first, end, items
                at += 1


def windows_of(items: Iterable[tuple], window: int = WINDOW) -> dict[tuple[bytes, ...], set]:
    """Windows of ``(item_id, text)`` rows; items without words have none."""
    out: dict[tuple[bytes, ...], set] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            out[tuple(words[k : k + window])].add(str(item))
    return out


def _pieces(text: str | None, window: int, most: int) -> Iterator[str | None]:
    """The text, or where it has more than ``most`` words, parts of it that have all of its windows."""
    if len(text or "") <= 2 * most:
        yield text
        return
    words = words_of(text)
    for k in range(0, max(1, len(words) - window + 1), most):
        yield b" ".join(words[k : k + most + window - 1]).decode("utf-8", "replace")


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for item, text in benchmark.where(F.col(id_col).isNotNull()).select(id_col, text_col).toLocalIterator():
        for part in _pieces(text, window, most):
            block.append((item, part))
            size += len(part or "") // 2
            if size >= most:
                yield block
                block, size = [], 0
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, min_share: float = 0.05, item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words, hit_spans, items, n_hit, contaminated``.

    ``hit_spans``: maximal runs of words inside occurrences, as pairs of word numbers; ``items``: the
    ids found, as strings, sorted. Contaminated: some words hit, and at least ``min_share`` of all.
    Null text has no words. Items with a null id or without words have no window; an empty benchmark
    hits nothing; an empty table gives an empty result. Repeated rows are judged each, and columns
    with the results' names are replaced. Benchmarks over ``block_words`` words are searched block by
    block over the whole table, the spans united.
    """
    made = ["n_words", "hit_spans", "items", "n_hit", "contaminated"]
    out = docs.drop(*made)
    spark, fields = docs.sparkSession, out.schema
    found_type = "array<struct<first:int,end:int>>"
    for block in _blocks(benchmark, item_col, item_text_col, window, block_words):
        table = spark.sparkContext.broadcast(WuManber(windows_of(block, window)))
        first = "hit_spans" not in out.columns

        def search(batches: Iterable[pa.RecordBatch], table=table, first=first) -> Iterator[pa.RecordBatch]:
            wm = table.value
            pair = pa.struct([("first", pa.int32()), ("end", pa.int32())])
            for b in batches:
                n_words, hit, items = [], [], []
                old = None if first else (b.column("hit_spans").to_pylist(), b.column("items").to_pylist())
                for lo, hi, buf, off in chunks(b.column(text_col)):
                    buf = LOWER[buf]
                    starts, ends, bounds = spans(buf, off, ALNUM)
                    ids, raw = hashes(buf, starts, ends), buf.tobytes()
                    for k in range(hi - lo):
                        a, z = int(bounds[k]), int(bounds[k + 1])
                        got, who = [], set()
                        for f, e, names in wm.find(ids[a:z].tolist(), lambda w: raw[starts[a + w] : ends[a + w]]):
                            got.append((f, e))
                            who.update(names)
                        if old:
                            got += [(s["first"], s["end"]) for s in old[0][lo + k]]
                            who.update(old[1][lo + k])
                        merged: list[list[int]] = []
                        for f, e in sorted(got):
                            if merged and f <= merged[-1][1]:
                                merged[-1][1] = max(e, merged[-1][1])
                            else:
                                merged.append([f, e])
                        n_words.append(z - a)
                        hit.append([{"first": f, "end": e} for f, e in merged])
                        items.append(sorted(who))
                names = [f.name for f in fields]
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in names] + [pa.array(n_words, pa.int64()), pa.array(hit, pa.list_(pair)), pa.array(items, pa.list_(pa.string()))],
                    [*names, "n_words", "hit_spans", "items"],
                )

        schema = extended(fields, f"n_words long, hit_spans {found_type}, items array<string>")
        out = out.mapInArrow(search, schema)
    out = out.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["first"]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(min_share) * F.col("n_words")))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS m, array_to_string(ws[k:k + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13 + 1, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM p),
dw AS (
  SELECT r, k, m, array_to_string(ws[k:k + m - 1], ' ') AS win
  FROM (SELECT r, ws, m, unnest(range(1, greatest(len(ws) - m + 2, 1))) AS k FROM w, sizes WHERE len(ws) >= m)),
o AS (SELECT r, k, dw.m, item_id FROM dw JOIN p ON dw.win = p.win AND dw.m = p.m),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS j FROM (SELECT DISTINCT r, k, m FROM o)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM o) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
