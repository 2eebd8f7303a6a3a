"""Repeated byte strings by suffix arrays, built by linear grouping in many short texts at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenmatch.llm.arrow import map_batches, raw_bytes, slices
from lumenmatch.llm.tokens import BASE, mix, powers
from lumenmatch.session import staged

#: Bytes of a string that may not repeat, and bytes that an anchor's hash covers.
LENGTH, GRAM = 200, 32
#: Most different contexts in one suffix array; an anchor with more has several, compared by window hashes.
LANE = 64
#: Bytes hashed at once, bytes of contexts sorted at once and held for dealing them out by size.
CHUNK, BATCH, HELD = 1 << 20, 1 << 20, 6 << 20
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_INVERSES = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    """The first ``n`` powers of BASE's inverse modulo 2 ** 64."""
    global _INVERSES
    with np.errstate(over="ignore"):
        while len(_INVERSES) < n:
            _INVERSES = np.concatenate([_INVERSES, _INVERSES * (_INVERSES[-1] * _INVERSE)])
    return _INVERSES[:n]


# ---------------------------------------------------------------------------------------------- suffix arrays


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``sizes`` of them."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def suffix_arrays(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix arrays of several texts: ``symbols`` holds them one after another from index 1 on (index 0 is not used), ``ends``
    their first index and then each one's end. The last symbol of a text must be smaller than all its others.

    Linear grouping (Baier 2016), a group of every text in each step. Suffixes are grouped by first symbol. Phase 1 takes the
    groups in descending order: each member points to the nearest suffix before it in a lower group (its previous smaller
    one, found over the pointers of suffixes in between), and those, by how many members point to them, move to groups of
    their own behind the rest of theirs. Then a group is a Lyndon prefix of its members. Phase 2 takes the groups in ascending
    order: after the prefix, repeated or not, each member goes on as a suffix whose place is known, which gives the order.
    """
    n, texts = len(symbols), len(ends) - 1
    first, last = ends[:-1], ends[1:]
    owner = np.repeat(np.arange(texts), np.diff(ends))
    slots = np.zeros(n, np.int64)  # suffix in each place
    slots[1:] = 1 + np.lexsort((symbols[1:], owner))
    place = np.empty(n, np.int64)
    place[slots] = np.arange(n)
    head = np.ones(n, bool)
    head[2:] = (symbols[slots[2:]] != symbols[slots[1:-1]]) | (owner[slots[2:] - 1] != owner[slots[1:-1] - 1])
    starts = np.flatnonzero(head)
    size, length = np.zeros(n, np.int64), np.zeros(n, np.int64)  # by a group's first place
    size[starts] = np.diff(np.append(starts, n))
    length[starts] = 1
    group = np.empty(n, np.int64)
    group[slots] = np.repeat(starts, size[starts])
    group[0] = -1
    before = np.zeros(n, np.int64)
    moved = np.zeros(n, bool)
    todo, low = last.copy(), first.copy()
    while len(todo):
        now = group[slots[todo - 1]]
        count = todo - now
        members = slots[_ragged(now, count)]
        floor, current = np.repeat(low, count), np.repeat(now, count)
        before[members] = members - 1
        open_, bound = members, current
        while len(open_):
            to = before[open_]
            more = group[to] >= bound
            open_, bound = open_[more], bound[more]
            before[open_] = before[to[more]]
        to = before[members]
        inside = to >= floor
        to, by = to[inside], current[inside]
        if len(to):
            order = np.argsort(to, kind="stable")
            to, by = to[order], by[order]
            new = np.ones(len(to), bool)
            new[1:] = to[1:] != to[:-1]
            at = np.flatnonzero(new)
            target, by, times = to[at], by[at], np.diff(np.append(at, len(to)))
            home = group[target]
            order = np.lexsort((times, home))
            target, home, times, by = target[order], home[order], times[order], by[order]
            new = np.ones(len(home), bool)
            new[1:] = home[1:] != home[:-1]
            at = np.flatnonzero(new)
            touched = np.diff(np.append(at, len(home)))
            border = np.repeat(home[at] + size[home[at]] - touched, touched)
            goal = border + (np.arange(len(home)) - np.repeat(at, touched))
            old = place[target]
            moved[target] = True
            out = slots[goal]
            out = out[~moved[out]]
            hole = old[old < border]
            moved[target] = False
            slots[hole] = out
            place[out] = hole
            slots[goal] = target
            place[target] = goal
            # groups: a run of equal (home, times)
            new[1:] |= times[1:] != times[:-1]
            run = np.flatnonzero(new)
            runs = np.diff(np.append(run, len(home)))
            begin = goal[run]
            longer = length[home[run]] + times[run] * length[by[run]]
            size[home[at]] -= touched
            size[begin] = runs
            length[begin] = longer
            group[target] = np.repeat(begin, runs)
        going = now > low
        todo, low = now[going], low[going]

    # phase 2: groups of several members, the n-th of every text in one step
    starts = np.flatnonzero((group[slots[1:]] != np.concatenate([[-2], group[slots[1:-1]]]))) + 1 if n > 1 else np.zeros(0, np.int64)
    starts = starts[size[starts] > 1]
    text = owner[slots[starts] - 1]
    turn = np.arange(len(starts)) - np.searchsorted(text, text)
    order = np.argsort(turn, kind="stable")
    starts, edges = starts[order], np.searchsorted(turn[order], np.arange(int(turn.max(initial=-1)) + 2))
    for a, b in zip(edges[:-1], edges[1:]):
        now = starts[a:b]
        count = size[now]
        members = slots[_ragged(now, count)]
        of, step = np.repeat(now, count), np.repeat(length[now], count)
        rest = members + step
        times = np.zeros(len(members), np.int64)
        same = np.flatnonzero(group[rest] == of)
        while len(same):
            times[same] += 1
            rest[same] += step[same]
            same = same[group[rest[same]] == of[same]]
        order = np.lexsort((place[rest], times, of))
        goal = _ragged(now, count)
        slots[goal] = members[order]
        place[slots[goal]] = goal
    return slots


def repeated_windows(lanes: list[list[bytes]], length: int = LENGTH) -> tuple[list[list[np.ndarray]], list[list[np.ndarray]]]:
    """For every context of every lane, by window (a string of ``length`` bytes from each place on): whether the window is in the
    lane a second time, and whether it is the lane's first occurrence of its string (in suffix order)."""
    most = max(map(len, lanes), default=0)
    parts, ends = [np.zeros(1, np.int64)], [1]
    spots: list[list[int]] = []
    for lane in lanes:
        own = []
        for i, context in enumerate(lane):
            own.append(ends[-1] + sum(len(c) + 1 for c in lane[:i]) if i == 0 else own[-1] + len(lane[i - 1]) + 1)
            parts.append(np.frombuffer(context, np.uint8).astype(np.int64) + most)
            parts.append(np.array([len(lane) - 1 - i]))
        spots.append(own)
        ends.append(own[-1] + len(lane[-1]) + 1)
    symbols = np.concatenate(parts)
    order = suffix_arrays(symbols, np.array(ends))
    full = np.zeros(len(symbols), bool)
    for lane, own in zip(lanes, spots):
        for context, at in zip(lane, own):
            full[at : at + max(0, len(context) - length + 1)] = True
    order = order[1:]
    order = order[full[order]]
    padded = np.concatenate([(symbols - most).clip(0).astype(np.uint8), np.zeros(length + 8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64).ravel()
    lane_of = np.searchsorted(np.array(ends), order, side="right")
    pairs = np.flatnonzero(lane_of[1:] == lane_of[:-1])
    for k in [*range(0, length - 7, 8), length - 8]:
        pairs = pairs[eight[order[pairs] + k] == eight[order[pairs + 1] + k]]
    again, leads = np.zeros(len(symbols), bool), full.copy()
    again[order[pairs]] = again[order[pairs + 1]] = True
    leads[order[pairs + 1]] = False
    cut = lambda flags: [[flags[at : at + max(0, len(c) - length + 1)] for c, at in zip(lane, own)] for lane, own in zip(lanes, spots)]
    return cut(again), cut(leads)


# ---------------------------------------------------------------------------------------------- anchors


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, anchor hash and context hash of each context.

    Each window of ``length`` bytes has one anchor: of its strings of ``gram`` bytes that with the smallest hash, the first of
    equal ones. The bytes of the window alone decide, so equal windows have equal anchors. A context is a run of windows with
    one anchor. Texts below ``length`` bytes have none.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
        back = inverses(n)
        grams = mix((total[gram:] - total[:-gram]) * back[: n - gram + 1])
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        span, done = length - gram + 1, 1
        while done < span:
            shift = min(done, span - done)
            key = np.minimum(key[:-shift], key[shift:])
            done += shift
        place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # by window start; n - length + 1 of them
        owner = np.searchsorted(offsets, np.arange(len(place)), side="right") - 1
        whole = np.arange(len(place)) + length <= offsets[owner + 1]
        start = np.flatnonzero(whole)
        if not len(start):
            return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
        new = np.ones(len(start), bool)
        new[1:] = (place[start[1:]] != place[start[:-1]]) | (owner[start[1:]] != owner[start[:-1]])
        at = np.flatnonzero(new)
        windows = np.diff(np.append(at, len(start)))
        begin = start[at]
        end = begin + windows + length - 1
        context = mix((total[end] - total[begin]) * back[begin] + windows.astype(np.uint64))
        return owner[begin], begin - offsets[owner[begin]], windows, grams[place[begin]], context


def _listed(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, text_hash and, as parallel arrays over a text's contexts: anchor, context (hashes), start, windows."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + T.StructType.fromDDL("text_hash long, anchor array<long>, context array<long>, start array<long>, windows array<long>").fields
    )

    def work(batch):
        data, offsets = raw_bytes(batch.column("text"))
        for a, b in slices(offsets, CHUNK):
            own = offsets[a : b + 1] - offsets[a]
            text, start, windows, anchor, context = anchors(data[offsets[a] : offsets[b]], own, length, gram)
            ends = np.searchsorted(text, np.arange(b - a + 1))
            part = batch.slice(a, b - a)
            yield {
                "doc_id": part.column("doc_id"),
                "text_hash": part.column("text_hash"),
                "anchor": _listed(anchor.view(np.int64), ends, pa.int64()),
                "context": _listed(context.view(np.int64), ends, pa.int64()),
                "start": _listed(start, ends, pa.int64()),
                "windows": _listed(windows, ends, pa.int64()),
            }

    return map_batches(docs, schema, work)


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _sorted_lanes(contexts: DataFrame, length: int) -> DataFrame:
    """anchor, context, runs (of windows that repeat in the lane) and, where an anchor has several lanes, windows (hash, place,
    alone) for each string of the lane once, of every context. Input: anchor, lane, lanes, context, bytes, sorted by lane."""
    schema = T.StructType.fromDDL("anchor long, context long, runs array<struct<a:long,b:long>>, windows array<struct<hash:binary,at:long,alone:boolean>>")
    names, target = schema.names, to_arrow_schema(schema)

    def run(batches):
        held: list[tuple] = []  # (anchor, lane, lanes, [(context, bytes)])
        weight = 0

        def sort(everything: bool):
            nonlocal held, weight
            rest = [] if everything else [held.pop()]  # more of the last lane may follow
            held.sort(key=lambda x: sum(len(c) for _, c in x[3]))
            at = 0
            while at < len(held):
                end, total = at, 0
                while end < len(held) and (end == at or total < BATCH):
                    total += sum(len(c) for _, c in held[end][3])
                    end += 1
                part = held[at:end]
                again, leads = repeated_windows([[c for _, c in x[3]] for x in part], length)
                rows = []
                for (anchor, _, lanes, own), twice, lead in zip(part, again, leads):
                    for (context, raw), t, first in zip(own, twice, lead):
                        shown = []
                        if lanes > 1:
                            shown = [{"hash": xxhash.xxh3_128_digest(raw[i : i + length]), "at": int(i), "alone": not t[i]} for i in np.flatnonzero(first)]
                        rows.append((anchor, context, _runs(t), shown))
                yield pa.RecordBatch.from_pydict(dict(zip(names, (list(x) for x in zip(*rows)))), schema=target)
                at = end
            held, weight = rest, sum(len(c) for x in rest for _, c in x[3])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "lane", "lanes", "context", "bytes")]
            for anchor, lane, lanes, context, raw in zip(*columns):
                if not held or held[-1][:2] != (anchor, lane):
                    if weight > HELD:
                        yield from sort(True)
                    held.append((anchor, lane, lanes, []))
                held[-1][3].append((context, raw))
                weight += len(raw)
        if held:
            yield from sort(True)

    return contexts.mapInArrow(run, schema)


def repeated_places(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash and places (array of (a, b): windows a to b - 1 of the text repeat somewhere) of the texts that have any.

    1. Windows are bundled by anchors (about one in 85 bytes). Anchors are counted by hash, with partial counts.
    2. Where all contexts of a repeated anchor are equal, all their windows repeat. Of the others one text is cut out per
       different context, and suffix arrays over the contexts of an anchor find the equal windows.
    3. An anchor with over LANE contexts has several suffix arrays. Each tells the hashes of its strings, one row a string;
       those that two arrays tell repeat as well. So no group is held whole, however many texts share a passage.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    rows = staged(anchor_rows(keyed, length, gram), "anchors")
    flat = rows.select("doc_id", "text_hash", F.explode(F.arrays_zip("anchor", "context", "start", "windows")).alias("c")).select("doc_id", "text_hash", "c.*")
    counted = rows.select(F.explode(F.arrays_zip("anchor", "context")).alias("c")).groupBy("c.anchor").agg(
        F.count("*").alias("n"), F.min("c.context").alias("low"), F.max("c.context").alias("high")
    )
    twice = counted.filter("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("equal"))
    pairs = staged(flat.join(twice, "anchor"), "pairs")

    spot = F.struct("doc_id", "text_hash", "start", "windows")
    mixed = staged(pairs.filter("not equal").groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(spot).alias("spot")), "mixed")
    crowds = mixed.groupBy("anchor").agg(F.count("*").alias("many")).filter(F.col("many") > LANE)
    dealt = mixed.join(crowds, "anchor", "left").withColumn("lanes", F.coalesce(F.ceil(F.col("many") / LANE), F.lit(1)).cast("long"))
    asked = dealt.groupBy("spot.doc_id", "spot.text_hash").agg(
        F.collect_list(F.struct("anchor", F.pmod("context", "lanes").alias("lane"), "lanes", "context", F.col("spot.start").alias("start"), F.col("spot.windows").alias("windows"))).alias("asked")
    )
    named = asked.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "asked")
    found = keyed.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    one = found.select(F.col("text").cast("binary").alias("raw"), F.explode("asked").alias("c"))
    contexts = one.select("c.anchor", "c.lane", "c.lanes", "c.context", F.substring("raw", F.col("c.start") + 1, F.col("c.windows") + (length - 1)).alias("bytes"))
    lanes = staged(_sorted_lanes(contexts.repartition("anchor", "lane").sortWithinPartitions("anchor", "lane"), length), "lanes")

    told = lanes.select("anchor", "context", F.explode("windows").alias("w")).select("anchor", "context", "w.*")
    shared = told.groupBy("anchor", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "hash")
    beyond = told.filter("alone").join(shared, ["anchor", "hash"], "left_semi").select("anchor", "context", F.array(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("runs"))
    runs = lanes.select("anchor", "context", "runs").union(beyond).filter(F.size("runs") > 0)
    runs = runs.groupBy("anchor", "context").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    several = mixed.filter("n > 1").select("anchor", "context", F.lit(True).alias("several"))
    marks = runs.join(several, ["anchor", "context"], "full")

    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("windows").alias("b")))
    marked = pairs.filter("not equal").join(marks, ["anchor", "context"]).select("doc_id", "text_hash", "start", F.when(F.col("several"), whole).otherwise(F.col("runs")).alias("runs"))
    marked = marked.union(pairs.filter("equal").select("doc_id", "text_hash", "start", whole.alias("runs")))
    shifted = F.transform("runs", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))
    return marked.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list(shifted)).alias("places"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """row (a struct of all columns), n_bytes, n_removed, n_spans, kept_sha256 (and, if asked for, kept as binary) of every row.

    Every byte goes that a string of ``length`` bytes covers which also starts anywhere else, in this text or another; texts are
    UTF-8 bytes, strings don't cross texts and are judged on the input.

    Defined cases: null and empty texts, and those below ``length`` bytes, lose nothing; a repeated row (equal doc_id and text)
    makes all strings of both repeat; a null doc_id is as good as any; an empty table gives no rows. Other columns stay in row.
    """
    places = repeated_places(docs, length, gram).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    packed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    joined = packed.join(places, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    schema = T.StructType([packed.schema["row"]] + T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept).fields)

    def work(batch):
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = []
            for raw, where in zip(part.column("raw").to_pylist(), part.column("places").to_pylist()):
                kept, spans, end, gone = [], 0, 0, 0
                for a, b in sorted((p["a"], p["b"] - 1 + length) for p in where or ()):
                    if a > end or not spans:
                        kept.append(raw[end:a])
                        spans, gone, end = spans + 1, gone + b - a, b
                    elif b > end:
                        gone, end = gone + b - end, b
                kept = b"".join([*kept, raw[end:]])
                rows.append((len(raw), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), (list(x) for x in zip(*rows))))
            yield {"row": part.column("row"), **{k: v for k, v in columns.items() if k != "kept" or with_kept}}

    return map_batches(joined.select("row", "raw", "places"), schema, work)
