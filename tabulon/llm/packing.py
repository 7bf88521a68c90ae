"""Filling fixed-capacity containers with items (problem 7).

Token counts come from a public byte-level BPE vocabulary whose path is a parameter. Packing
is mixture-controlled: deficit round-robin over the queues of the sources admits items until
each source has its target share of a window's tokens, and the items at hand go, largest
first, to the fullest container that still takes them. A window then closes with
well-filled containers, chosen in turn by what their sources lack, as many as its budget of
tokens; the items of the others go back to the head of
their queues with their credit. A container thus belongs to one window, the mixture of a window is
that of its containers, and what a source lacks or exceeds in them is carried as its deficit
into the next window, and from one partition into the next. An item longer than the capacity
is cut into full containers and one remainder, which is packed like an item.

A window is measured in tokens: at least WINDOW_CONTAINERS containers and, since a container
of a small class may hold less than one item, at least WINDOW_ITEMS items of mean length.

The partitions are hash buckets of items, whatever their source, sized by ``BUCKET_ITEMS``,
so a source that holds a third of all items is spread like any other. The deficits at the
start of each bucket follow from the token totals per (bucket, source), one row per
bucket and source that it holds; it is joined, not collected.

Defined results: a null or empty text has no tokens and takes no container; items without a
source form a queue of their own; containers of equal class name are an error of the input
and give the items once for each; a capacity below 1 is ignored; repeated texts are items
like others; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Documented parameters: vocabulary file, items per packing partition, containers and items of mean length that a window holds at least.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BUCKET_ITEMS = 20_000
WINDOW_CONTAINERS, WINDOW_ITEMS = 32, 2_048
#: Share of a window's budget that is packed beyond it, to choose well-filled containers from.
RESERVE = 1.0
#: Share of its capacity that a well-filled container may leave unused.
SPARE = 0.01
#: Partitions into which the buckets are spread at most.
MAX_PARTITIONS = 20_000

# Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, loaded once per Python worker."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, source, n_tokens) of every item."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)._core_bpe
        for b in batches:
            n = [len(bpe.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["key", "source", "n_tokens"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text")).mapInArrow(count, f"key {kind}, source string, n_tokens bigint")


def best_fit(pieces: list[tuple], capacity: int) -> list[tuple[int, list[tuple]]]:
    """(room left, pieces) of each container after best fit, largest first; a piece starts with its tokens."""
    boxes: list[list] = []
    rooms: dict[int, list[int]] = {}  # open containers by the room left in them
    sizes: list[int] = []  # the rooms that occur, ascending
    for piece in sorted(pieces, reverse=True):
        n = piece[0]
        at = bisect.bisect_left(sizes, n)
        if at == len(sizes):
            box, room = len(boxes), capacity
            boxes.append([capacity, []])
        else:
            room = sizes[at]
            box = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], sizes[at]
        boxes[box][1].append(piece)
        boxes[box][0] = left = room - n
        if left:
            if left not in rooms:
                bisect.insort(sizes, left)
            rooms.setdefault(left, []).append(box)
    return [(left, held) for left, held in boxes]


def closing_order(boxes: list[tuple[int, list[tuple]]], capacity: int, sources: list[str], share: dict[str, float]) -> Iterator[tuple[int, list[tuple]]]:
    """Well-filled containers in turn by what their sources lack so far, then the others, fullest first."""
    by_source: dict[str, deque] = {}
    others = []
    for box in sorted(boxes, key=lambda b: b[0]):
        if box[0] > SPARE * capacity:
            others.append(box)
            continue
        has: dict[str, int] = {}
        for n, i, _ in box[1]:
            has[sources[i]] = has.get(sources[i], 0) + n
        by_source.setdefault(max(has, key=lambda s: has[s] / max(share.get(s, 0.0), 1e-12)), deque()).append((box, has))
    got, total = dict.fromkeys(by_source, 0), 0
    while by_source:
        s = max(by_source, key=lambda s: (share.get(s, 0.0) * total - got.get(s, 0), share.get(s, 0.0), s))
        box, has = by_source[s].popleft()
        if not by_source[s]:
            del by_source[s]
        for o, n in has.items():
            got[o] = got.get(o, 0) + n
            total += n
        yield box
    yield from others


def fill(keys: list, tokens: list[int], sources: list[str], share: dict[str, float], deficit: dict[str, float], capacity: int, budget: int) -> list[tuple]:
    """Packs one bucket: (key, piece, start, n, container, window) per piece; a window closes with about ``budget`` tokens."""
    out, made, window = [], 0, 0
    queues: dict[str, deque] = {}
    for i, s in enumerate(sources):
        full, last = divmod(tokens[i], capacity)
        for p in range(full):
            queues.setdefault(s, deque()).append((capacity, i, p))
        if last:
            queues.setdefault(s, deque()).append((last, i, full))
    credit = {s: deficit.get(s, 0.0) for s in queues}
    whole = sum(share.get(s, 0.0) for s in queues) or 1.0
    at_hand = 0  # tokens that went back to the queues
    while any(queues.values()):
        # deficit round-robin: every source earns its share and spends it in turn; more than the budget is packed, so that what closes is well filled
        admitted, size, want = [], 0, int(budget * (1 + RESERVE))
        for s in queues:
            credit[s] += max(0, want - at_hand) * share.get(s, 0.0) / whole
        turn = deque(sorted((s for s in queues if queues[s]), key=lambda s: (-credit[s], s)))
        while turn and size < want:
            s = turn.popleft()
            if credit[s] <= 0 and admitted:
                continue
            piece = queues[s].popleft()
            credit[s] -= piece[0]
            size += piece[0]
            admitted.append(piece)
            if queues[s]:
                turn.append(s)
        last = not any(queues.values())
        closed = at_hand = 0
        boxes = best_fit(admitted, capacity)
        for left, held in boxes if last else closing_order(boxes, capacity, sources, share):
            if closed < budget or last:
                out.extend((keys[i], p, p * capacity, n, made, window) for n, i, p in held)
                made, closed = made + 1, closed + capacity - left
                continue
            for piece in held:
                s = sources[piece[1]]
                queues[s].appendleft(piece)
                credit[s] += piece[0]
                at_hand += piece[0]
        window += 1
    return out


def pack(items: DataFrame, containers: DataFrame, bucket_items: int = BUCKET_ITEMS, window: int = WINDOW_CONTAINERS, window_items: int = WINDOW_ITEMS) -> DataFrame:
    """items (key, source, n_tokens) into containers (container_class, capacity_tokens).

    Returns container_class, capacity, bucket, container_no (within its bucket), key, source,
    piece_no, start_token, n_tokens, target_share.
    """
    classes = sorted((r[0], int(r[1])) for r in containers.filter("capacity_tokens >= 1").select("container_class", "capacity_tokens").collect())  # a table of settings
    n_items, mean = items.filter("n_tokens > 0").agg(F.count("*"), F.coalesce(F.avg("n_tokens"), F.lit(1.0))).first()
    buckets = max(1, -(-n_items // bucket_items))
    partitions = min(buckets, MAX_PARTITIONS)
    items = items.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    totals = items.groupBy("bucket", "source").agg(F.sum("n_tokens").alias("tokens"))
    whole = F.sum("s").over(W.partitionBy(F.lit(1)))  # over one row per source
    shares = totals.groupBy("source").agg(F.sum("tokens").alias("s")).select("source", F.coalesce(F.try_divide(F.col("s"), whole), F.lit(0.0)).alias("share"))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = totals.groupBy("bucket").agg(F.sum("tokens").alias("tokens")).select("bucket", before(W.orderBy("bucket")).alias("all_before"))  # one row per bucket
    # what the earlier buckets owe a source: its share of their tokens less what it had there
    owed = F.col("share") * F.col("all_before") - F.col("own_before")
    plan = totals.withColumn("own_before", before(W.partitionBy("source").orderBy("bucket"))).join(sizes, "bucket").join(shares, "source").select(F.col("bucket").alias("of_bucket"), F.col("source").alias("of_source"), "share", owed.alias("deficit"))
    kind = dict(items.dtypes)["key"]
    schema = f"container_class string, capacity int, bucket int, container_no int, window_no int, key {kind}, source string, piece_no int, start_token bigint, n_tokens bigint, target_share double"
    columns = [f.split()[0] for f in schema.split(", ")]

    def packed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        left = left.sort_values("key")
        keys, tokens, sources = left["key"].tolist(), left["n_tokens"].tolist(), left["source"].tolist()
        source_of = dict(zip(keys, sources, strict=True))
        share, deficit = dict(zip(right["of_source"], right["share"], strict=True)), dict(zip(right["of_source"], right["deficit"], strict=True))
        frames = []
        for name, capacity in classes:
            f = pd.DataFrame(fill(keys, tokens, sources, share, deficit, capacity, max(window * capacity, int(window_items * mean))), columns=["key", "piece_no", "start_token", "n_tokens", "container_no", "window_no"])
            f["source"] = f["key"].map(source_of)
            f["target_share"] = f["source"].map(share)
            f["container_class"], f["capacity"], f["bucket"] = name, capacity, left["bucket"].iat[0]
            frames.append(f[columns])
        return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=columns)

    # a number of partitions given by hand is not merged by adaptive execution
    spread = items.repartition(partitions, "bucket").groupBy("bucket")
    return spread.cogroup(plan.repartition(partitions, "of_bucket").groupBy("of_bucket")).applyInPandas(packed, schema)


def pack_documents(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The container of every document: container_class, capacity, container (unique in its class), doc_id, source, piece_no, start_token, n_tokens, target_share."""
    from tabulon.session import cut

    items = cut(token_counts(documents, vocabulary=vocabulary))  # tokenized once, read for totals and packing
    p = pack(items, containers)
    return p.select("container_class", "capacity", F.concat_ws("-", "bucket", "container_no").alias("container"), F.col("key").alias("doc_id"), F.concat_ws("-", "bucket", "window_no").alias("window"), "source", "piece_no", "start_token", "n_tokens", "target_share")


def space(packed: DataFrame) -> DataFrame:
    per = packed.groupBy("container_class", "capacity").agg(F.count_distinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return per.withColumn("unused", F.lit(1.0) - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))


def mixture(packed: DataFrame) -> DataFrame:
    """Per class: windows and the mean distance, in share of tokens, of a window's mixture from the target."""
    per = packed.groupBy("container_class", "window", "source").agg(F.sum("n_tokens").alias("n"), F.max("target_share").alias("target"))
    size = F.sum("n").over(W.partitionBy("container_class", "window"))
    known = F.sum("target").over(W.partitionBy("container_class", "window"))
    per = per.withColumn("off", F.abs(F.col("n") / size - F.col("target"))).withColumn("absent", F.lit(1.0) - known)
    per = per.groupBy("container_class", "window").agg(((F.sum("off") + F.max("absent")) / 2).alias("distance"), F.sum("n").alias("n"))
    return per.groupBy("container_class").agg(F.count("*").alias("n_windows"), (F.sum(F.col("distance") * F.col("n")) / F.sum("n")).alias("mean_distance"))
