"""Packing documents into containers with a controlled mixture of sources.

Documents are spread over shards by a hash, without their texts.  In a shard each source is a
queue.  Deficit round robin over the queues fills the containers of one window after the other to
the sources' shares: with every container each source is owed its share of it, what it gives is
taken off, and a source may be ahead by less than a container.  What a source is owed is carried into the next
window.  Between shards it is settled: a source's share of a container is its share of all tokens, plus what it is
owed when the shard begins less what it will be owed when it ends, spread over the shard's containers.  That
is its share of the shard's own tokens, so no queue runs dry long before the others and no shard waits for another.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers of a window, and documents of a shard on average.
WINDOW, SHARD = 640, 50_000
#: Share of a container that a source may be ahead by.
AHEAD = 0.75


def pack_shard(items: list[tuple[object, object, int, int, int]], capacity: int, window: int) -> list[tuple]:
    """Packs (doc, source, piece, start, tokens), at most ``capacity`` tokens each.

    Returns (container, position, window, doc, source, piece, start, tokens), containers from 0.

    A source is eligible for documents that don't put it further ahead than ``AHEAD``.  While a container is
    less than half full, the source that is owed most among the eligible ones gives its largest document that
    fits; then the largest that fits of any eligible source goes in.  Only if no source is eligible, the one
    that is owed most of those with something that fits gives it, and not for the last fiftieth of a container.
    The sizes present are bits of one number for each source, so the largest that fits is found
    without a search.
    """
    queue: dict = defaultdict(lambda: defaultdict(list))
    for item in sorted(items, key=lambda x: (str(x[1]), x[4], str(x[0]), x[2], x[3]), reverse=True):
        queue[item[1]][item[4]].append(item)
    bits = {s: sum(1 << n for n in sizes) for s, sizes in queue.items()}
    ahead = AHEAD * capacity
    rank = {s: k for k, s in enumerate(sorted(queue, key=lambda s: (s is not None, str(s))))}
    whole = sum(item[4] for item in items)
    share = {s: sum(n * len(found) for n, found in sizes.items()) / whole for s, sizes in queue.items()}
    deficit = dict.fromkeys(rank, 0.0)
    largest = lambda s, most: (bits[s] & ((1 << (max(most, 0) + 1)) - 1)).bit_length() - 1
    owed = lambda s: (deficit[s], rank[s])
    out: list[tuple] = []
    container = 0
    while bits:
        for s in deficit:
            deficit[s] += share[s] * capacity
        room, position = capacity, 0
        while room > 0:
            best, size = None, 0
            if room * 2 > capacity:
                for s in sorted(bits, key=owed, reverse=True):
                    size = largest(s, min(room, int(deficit[s] + ahead)))
                    if size > 0:
                        best = s
                        break
            else:
                for s in bits:
                    most = min(room, int(deficit[s] + ahead))
                    if most < max(size, 1):
                        continue
                    n = largest(s, most)
                    if n > size or (n == size > 0 and owed(s) > owed(best)):
                        best, size = s, n
            if best is None:
                fits = [s for s in bits if largest(s, room) > 0]
                if not fits or (position and room * 50 < capacity):
                    break
                best = max(fits, key=owed)
                size = largest(best, room)
            doc, source, piece, start, tokens = queue[best][size].pop()
            if not queue[best][size]:
                del queue[best][size]
                bits[best] ^= 1 << size
                if not bits[best]:
                    del bits[best]
            deficit[best] -= size
            out.append((container, position, container // window, doc, source, piece, start, tokens))
            room -= size
            position += 1
        container += 1
    return out


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    capacity: int = 6000,
    window: int = WINDOW,
    shards: int | None = None,
) -> DataFrame:
    """Every token of every document in exactly one container of ``capacity`` tokens.

    Columns: ``container`` (bigint), ``position`` (from 0), ``window``, ``doc``, ``source``, ``piece``,
    ``start_token`` and ``n_tokens``.  A token is a byte of the UTF-8 text.  A document stays
    whole unless it alone exceeds the capacity; then it is cut into pieces that fill a container
    each and one that holds the rest.  A source's target is its share of the tokens of its shard.

    ``shards`` (default: as many as keep them at ``SHARD`` documents, whatever the session's settings) bounds
    what one task holds: ids, sources and sizes of its documents.  A hot source is spread over all shards.

    A NULL source is a source of its own.  NULL and empty texts hold no token and give no rows.
    Repeated rows are packed each for itself.  An empty table gives no rows.  Other columns are
    not read.  The result is a function of the rows, not of their order.
    """
    n_shards = shards or docs.count() // SHARD + 1
    sized = docs.select(
        docs[id_col].alias("doc"), docs[source_col].cast("string").alias("source"), F.octet_length(docs[text_col].cast("string")).cast("bigint").alias("tokens")
    ).where("tokens > 0")
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc", "tokens"), F.lit(n_shards)).cast("int"))
    kind = sized.schema["doc"].dataType.simpleString()
    names = ["container", "position", "window", "doc", "source", "piece", "start_token", "n_tokens"]
    types = [pa.int64(), pa.int32(), pa.int32(), None, pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        items = []
        for doc, source, tokens in zip(*[rows.column(c).to_pylist() for c in ("doc", "source", "tokens")], strict=True):
            for piece, start in enumerate(range(0, tokens, capacity)):
                items.append((doc, source, piece, start, min(capacity, tokens - start)))
        packed = list(zip(*pack_shard(items, capacity, window), strict=True))
        columns = [pa.array(c, t or rows.schema.field("doc").type) for c, t in zip(packed, types, strict=True)]
        columns[0] = pc.add(columns[0], key[0].as_py() << 32)
        return pa.table(columns, names)

    # By number, as adaptive execution would merge these small partitions into one.
    return (
        sized.repartition(n_shards, "shard")
        .groupBy("shard")
        .applyInArrow(pack, f"container bigint, position int, window int, doc {kind}, source string, piece int, start_token bigint, n_tokens bigint")
    )
