"""Near duplicates: a Jaccard self-join of shingle sets by token-combination prefixes, and the components of its links.

A token is a 64-bit hash of a 5-word shingle. Tokens go by class, rare ones before frequent ones, and by value in a class.
Two sets of n and n' tokens with Jaccard similarity t share o >= t n tokens, so the first K <= o tokens that they share stand
in the first n - ceil(t n) + K of either set. So if they share a rare token, they share one within the first n - ceil(t n) + 1:
single tokens are the signatures of the rare class. Otherwise all they share are frequent. With K = m + 1, two of the first K
fall in the same one of m classes of values: pairs of frequent tokens of one class, from the extended prefix, are the
signatures of the frequent class. m grows with n, so that a set has few pairs to a class. Which tokens count as frequent
changes the work, never the result.

Documents with equal sets are one node. Nodes that share a signature and could be similar are verified on whole sets: first
each node with its strongest partner, then those pairs whose nodes are still in different components. A
signature with few nodes gives all its pairs, and their number of shared single tokens bounds their overlap. A signature with
many nodes first measures each node against one hub. Then only nodes of different components are still paired, and only if
what they share and do not share with the hub lets them be similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import as_bytes, discard, held, release, row_key, written
from gradus.llm.components import components

SHINGLE = 5
#: Two sets link if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A token is frequent if it is counted this often: wherever it is early in a set, elsewhere if at least two sets of a chunk have it ...
FREQUENT_AT = 24
#: ... and is among this many most frequent ones, which every task holds (8 bytes each).
MOST_FREQUENT = 1 << 20
#: Nodes of a signature whose pairs are all made at once.
SMALL = 32
#: Tokens counted at a time; bits of the filter by which tasks leave out sets that no pair needs.
COUNTED, FILTER_BITS = 1 << 20, 1 << 27
#: 64-bit words of the map that bounds what two prefixes of a family share.
MAP_WORDS = 16
#: Rows of a batch that are worked on at once.
ROWS = 1000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd multipliers of the words of a shingle (any fixed odd values do).
_BY_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def tokens(text: bytes | None, hashes: dict) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; with fewer than 5 words the whole sequence's one."""
    ws = text.translate(_LOWER).split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), seed=len(ws))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = len(ws) - SHINGLE + 1
    total = h[:n] * _BY_PLACE[0]
    for k in range(1, SHINGLE):
        total += h[k : n + k] * _BY_PLACE[k]
    return np.unique(_mixed(total))


def node_of(s: np.ndarray) -> int:
    """A set's node: a signed 64-bit hash of its tokens."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def least_overlap(n: int) -> int:
    return -(-PERCENT * n // 100)


def class_counts(n: int) -> list[int]:
    """The numbers of classes under which a set of n tokens can meet another: those of all sizes that can be similar."""
    level = lambda size: 1 << max(0, (size // 32).bit_length() - 1)
    low, high = level(least_overlap(n)), level(100 * n // PERCENT)
    out = []
    while low <= high:
        out.append(low)
        low *= 2
    return out


def early(n: int) -> int:
    """The tokens of a set of n that are all counted: its plain prefix and an eighth more, as frequent ones give way to later ones."""
    return n - least_overlap(n) + 1 + n // 8


def signatures(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(single tokens, pairs' hashes) of a sorted set, given the sorted frequent tokens."""
    n = len(s)
    if not n:
        return s, s
    base = n - least_overlap(n) + 1
    often = np.zeros(n, bool) if not len(frequent) else frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    rare = s[~often]
    singles = rare[:base]
    if len(rare) >= base or n == 1:
        return (singles if n > 1 else s), s[:0]
    common, out = s[often], []
    for m in class_counts(n):
        part = common[: base + m - len(rare)]
        kind = (part >> np.uint64(7)) % np.uint64(m)
        order = np.argsort(kind, kind="stable")
        part, kind = part[order], kind[order]
        # All later tokens of the same class, one distance at a time.
        for far in range(1, len(part)):
            same = kind[far:] == kind[:-far]
            if not same.any():
                break
            a, b = part[:-far][same], part[far:][same]
            out.append(_mixed(_mixed(a * _BY_PLACE[0] + np.uint64(m)) + b * _BY_PLACE[1]))
    return singles, np.concatenate(out) if out else s[:0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    hashes = held(("word hashes",), WordHashes)
    return [tokens(t, hashes) for t in as_bytes(batch.column("text"))]


def describe(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (row_key, doc_id, n, node) of each document; (token, times) over a task's distinct sets.

    Early tokens, which could be signatures, have all their times here. Of the later ones only those that a chunk repeats do.
    """
    schema = "row_key long, doc_id long, n long, node long, token long, times long"
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        first, later, size = [], [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            for held, least in ((first, 1), (later, 2)):
                values, times = np.unique(np.concatenate(held), return_counts=True)
                values, times = values[times >= least].view(np.int64), times[times >= least]
                none = pa.nulls(len(values), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(values), pa.array(times)], names=names)

        for batch in _slices(batches):
            sets = _sets(batch)
            nodes = [node_of(s) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), none, none], names=names)
            for node, s in zip(nodes, sets, strict=True):
                if node not in seen and len(s):
                    seen.add(node)
                    first.append(s[: early(len(s))])
                    later.append(s[early(len(s)) :])
                    size += len(s)
                if size >= COUNTED:
                    yield from counted()
                    first, later, size = [], [], 0
        if first:
            yield from counted()

    return docs.select(row_key("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def frequent_tokens(described: DataFrame, at: int = FREQUENT_AT) -> np.ndarray:
    totals = described.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= at)
    rows = totals.orderBy(F.desc("times"), "token").limit(MOST_FREQUENT).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def sign(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(sig, node, n, p, single): the signatures of each distinct set; n its tokens, p its single signatures."""
    schema = "sig long, node long, n int, p int, single boolean"
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            rows, sigs = [], []
            for s in _sets(batch):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                singles, pairs = signatures(s, shared.value)
                sigs += [singles, pairs]
                rows += [(node, len(s), len(singles), True, len(singles)), (node, len(s), len(singles), False, len(pairs))]
            if rows:
                node, n, p, single, times = (np.array(c) for c in zip(*rows, strict=True))
                columns = [pa.array(np.repeat(c, times), t) for c, t in ((node, pa.int64()), (n, pa.int32()), (p, pa.int32()), (single, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), *columns], names=["sig", "node", "n", "p", "single"])

    return docs.select("text").mapInArrow(scan, schema)


_MET = "sig long, a long, b long, na int, nb int, pa int, pb int, shared int"
_MET_NAMES = [c.split()[0] for c in _MET.split(", ")]


def meet(signed: DataFrame, small: int = SMALL) -> DataFrame:
    """Per signature of 2 to ``small`` nodes its pairs (a < b) of possible sizes; per larger one a row (sig, first node, node) for each node."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        large = None  # (signature, leader, its size) of a large group that goes on
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "node", "n", "p", "single")}
            held = columns if held is None else {c: np.concatenate([held[c], columns[c]]) for c in columns}
            out, held, large = _grouped(held, large, False, small)
            yield from out
        if held is not None:
            yield from _grouped(held, large, True, small)[0]

    in_order = signed.repartition("sig").sortWithinPartitions("sig", "n", "node")
    return in_order.mapInArrow(groups, _MET)


def _grouped(rows: dict, large: tuple | None, last: bool, small: int):
    """Batches of the complete groups of sorted ``rows``, the rows of the group that may go on, and ``large`` as it then is."""
    sig, node = rows["sig"], rows["node"]
    if not len(sig):
        return [], rows, large
    fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
    rows = {c: v[fresh] for c, v in rows.items()}
    sig = rows["sig"]
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    sizes = np.diff(np.r_[starts, len(sig)])
    out, keep = [], {c: v[:0] for c, v in rows.items()}
    if not last:  # the last group may go on; a large one is handed on as it comes, all but its last row
        at = starts[-1]
        if sizes[-1] > small or (large and large[0] == sig[at]):
            keep = {c: v[-1:] for c, v in rows.items()}
            leader = large if large and large[0] == sig[at] else (sig[at], rows["node"][at], rows["n"][at])
            out += _led({c: v[at:-1] for c, v in rows.items()}, leader)
            held_large = leader
        else:
            keep = {c: v[at:] for c, v in rows.items()}
            held_large = None
        starts, sizes = starts[:-1], sizes[:-1]
    else:
        held_large = None
    if large and len(starts) and sig[starts[0]] == large[0]:
        out += _led({c: v[starts[0] : starts[0] + sizes[0]] for c, v in rows.items()}, large)
        starts, sizes = starts[1:], sizes[1:]
    for at, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        out += _led({c: v[at : at + size] for c, v in rows.items()}, (sig[at], rows["node"][at], rows["n"][at]))
    for size in np.unique(sizes[(sizes > 1) & (sizes <= small)]).tolist():
        i, j = np.triu_indices(size, 1)
        of = starts[sizes == size][:, None]
        out += _paired(rows, (of + i).ravel(), (of + j).ravel())
    return out, keep, held_large


def _led(rows: dict, leader: tuple) -> list[pa.RecordBatch]:
    k = len(rows["sig"])
    if not k:
        return []
    full = lambda v, t: pa.array(np.full(k, v, t))
    columns = [pa.array(rows["sig"]), full(leader[1], np.int64), pa.array(rows["node"]), full(leader[2], np.int32), pa.array(rows["n"], pa.int32()), full(0, np.int32), full(0, np.int32), full(0, np.int32)]
    return [pa.RecordBatch.from_arrays(columns, names=_MET_NAMES)]


def _paired(rows: dict, i: np.ndarray, j: np.ndarray) -> list[pa.RecordBatch]:
    able = 100 * rows["n"][i].astype(np.int64) >= PERCENT * rows["n"][j].astype(np.int64)  # n ascends in a group
    i, j = i[able], j[able]
    if not len(i):
        return []
    swap = rows["node"][i] > rows["node"][j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    columns = [pa.nulls(len(i), pa.int64()), pa.array(rows["node"][i]), pa.array(rows["node"][j])]
    columns += [pa.array(rows[c][k], pa.int32()) for c in ("n", "p") for k in (i, j)] + [pa.array(rows["single"][i].astype(np.int32))]
    return [pa.RecordBatch.from_arrays(columns, names=_MET_NAMES)]


def candidates(met: DataFrame) -> DataFrame:
    """(a, b, times) of the small signatures' pairs whose shared single tokens leave the needed overlap possible; ``times`` they met."""
    counts = (F.sum("shared").alias("shared"), F.count(F.lit(1)).alias("times"))
    pairs = met.where("sig is null").groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("na", "nb", "pa", "pb")], *counts)
    needed = F.ceil((F.col("na") + F.col("nb")).cast("long") * PERCENT / F.lit(100 + PERCENT) - F.lit(1e-9))
    return pairs.where(F.col("shared") + F.greatest(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= needed).select("a", "b", "times")


def strongest(found: DataFrame) -> DataFrame:
    """(a, b): each node of ``found`` (a, b, times) with the partner that it met most often; no more pairs than nodes."""
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "times"))
    best = both.groupBy("a").agg(F.max(F.struct("times", "b"))["b"].alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def apart(found: DataFrame, labels: DataFrame, done: DataFrame) -> DataFrame:
    """(a, b) of ``found`` that are in different components so far and not among the pairs ``done``: only these can still join any."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias("label_" + c))
    named = found.join(done.select("a", "b"), ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def families(large: DataFrame) -> DataFrame:
    """(hub, node): each node of a large signature with the signature's hub, its node with the most large signatures.

    Of copies that were each changed on their own, the original keeps the most in common with the others.
    """
    rows = large.select("sig", F.col("b").alias("node"))
    weighed = rows.join(rows.groupBy("node").agg(F.count(F.lit(1)).alias("weight")), "node")
    hubs = weighed.groupBy("sig").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    return rows.join(hubs, "sig").where("node <> hub").select("hub", "node").distinct()


def crossing(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of nodes of one family that are in different components so far.

    ``members`` has hub, node, their sizes m and n and their intersection k. A node's difference E is the hub's d tokens that it
    lacks and its own n - k others. Two nodes of a hub share m - d - d' + |E & E'| tokens, so they are similar if and only if
    2 (100 + PERCENT) |E & E'| >= G + G' with G as below. A node is linked to the hub if G is at most (100 - PERCENT) m, and no
    G is less than that negated; in two components, one node's G is more. So each node has a least |E & E'| for any partner,
    and the prefixes that it leaves, rarest tokens of the family first, share a token. What is left is checked on whole differences.
    """
    whole, slack = F.lit(100 + PERCENT), (100 - PERCENT) * F.col("m")
    named = members.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = named.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("hub")
    rows = named.join(several, "hub").withColumn("d", F.col("m") - F.col("k")).withColumn("g", 2 * PERCENT * F.col("n") + 2 * whole * F.col("d") - whole * F.col("m"))
    least = F.when(F.col("g") > slack, F.ceil((F.col("g") - slack) / (2 * whole))).otherwise(F.floor((F.col("g") + slack) / (2 * whole)) + 1)
    rows = written(rows.select("hub", "node", "n", "label", "g", (F.col("d") + F.col("n") - F.col("k")).alias("e"), least.alias("least")).where("e >= least"), "members")
    of = lambda c: sets.select(F.col("node").alias(c), F.col("tokens").alias("tokens_" + c))
    both = rows.select("hub", "node").join(of("node"), "node").join(of("hub"), "hub").select("hub", "node", "tokens_hub", "tokens_node")

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                found.append(np.concatenate([~np.setdiff1d(p, q, True), np.setdiff1d(q, p, True)]))
            diffs = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), diffs], names=["hub", "node", "diff"])

    diffs = written(both.mapInArrow(differences, "hub long, node long, diff array<long>").dropDuplicates(["hub", "node"]), "differences")
    tokens_ = diffs.select("hub", "node", F.explode("diff").alias("token"))
    shared = tokens_.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("times"))
    rarest = Window.partitionBy("hub", "node").orderBy("times", "token")
    ranked = tokens_.join(shared, ["hub", "token"]).withColumn("rank", F.row_number().over(rarest))
    prefixes = ranked.join(rows, ["hub", "node"]).where("rank <= e - least + 1 and times > 1").select("hub", "token", "node", "n", "label", "g", "e", "rank", "least")
    # A map of each prefix in a fixed number of bits bounds how many tokens two prefixes share: one for each bit that both
    # have, and those whose bit another of the same prefix has.
    place = F.pmod(F.col("token"), F.lit(64 * MAP_WORDS))
    word = lambda w: F.coalesce(F.bit_or(F.when(F.floor(place / 64) == w, F.expr("shiftleft(1L, int(pmod(token, 64)))"))), F.lit(0).cast("long"))
    maps = prefixes.groupBy("hub", "node").agg(F.count(F.lit(1)).alias("k"), F.array(*[word(w) for w in range(MAP_WORDS)]).alias("map"))
    bits = lambda words: F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))
    maps = maps.withColumn("spare", F.col("k") - bits(F.col("map"))).drop("k")
    prefixes = written(prefixes.join(maps, ["hub", "node"]), "prefixes")
    left, right = (prefixes.select("hub", "token", *[F.col(c).alias(c + side) for c in ("node", "n", "label", "g", "e", "rank", "least", "map", "spare")]) for side in ("_a", "_b"))
    # What both can share up to this token, and after it.
    most = F.least("rank_a", "rank_b") + F.least(F.col("e_a") - F.col("rank_a"), F.col("e_b") - F.col("rank_b"))
    both_maps = bits(F.zip_with("map_a", "map_b", lambda x, y: x.bitwiseAND(y))) + F.least("spare_a", "spare_b")
    most = F.least(most, both_maps + F.greatest("least_a", "least_b") - 1)
    able = 2 * whole * most >= F.col("g_a") + F.col("g_b")
    sizes = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    met = left.join(right, ["hub", "token"]).where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & sizes & able)
    pairs = met.select("hub", F.col("node_a").alias("a"), F.col("node_b").alias("b"), (F.col("g_a") + F.col("g_b")).alias("g")).distinct()
    side = lambda c: diffs.select("hub", F.col("node").alias(c), F.col("diff").alias("diff_" + c))
    checked = pairs.join(side("a"), ["hub", "a"]).join(side("b"), ["hub", "b"])
    return written(checked.where(2 * whole * F.size(F.array_intersect("diff_a", "diff_b")) >= F.col("g")).select("a", "b").distinct(), "links")


def whole_sets(docs: DataFrame, described: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, tokens) for the nodes of ``pairs``: one document of each is scanned again, found by a filter of fixed size.

    The filter lets some other documents pass, more where it holds many; they only cost time.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = described.groupBy("node").agg(F.min("row_key").alias("row_key")).join(nodes, "node")
    placed = rows.select(F.pmod("row_key", F.lit(FILTER_BITS)).alias("place")).selectExpr("place div 64 AS word", "shiftleft(1L, int(place % 64)) AS bit")
    words = placed.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    got = words.toPandas()  # at most FILTER_BITS / 64 rows
    bits[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bits.astype("<i8").view(np.uint8))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            at = np.mod(batch.column("row_key").to_numpy(zero_copy_only=False), FILTER_BITS)
            passed = np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            found = {node_of(s): s for s in _sets(batch.take(pa.array(passed)))}
            new = {k: s for k, s in found.items() if k not in seen and len(s)}
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array([s.tobytes() for s in new.values()], pa.binary())], names=["node", "tokens"])

    sets = docs.select(row_key("doc_id", "text").alias("row_key"), "text").mapInArrow(scan, "node long, tokens binary")
    return written(sets, "sets")


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, both) of each of ``pairs`` (a written table): the sizes of the sets and of their intersection; written."""
    sides = [sets.select(F.col("node").alias(c), F.col("tokens").alias("tokens_" + c)) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "tokens_a", "tokens_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                few, many = (p, q) if len(p) <= len(q) else (q, p)
                rows.append((len(p), len(q), int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=["a", "b", "na", "nb", "both"])

    measured = both.mapInArrow(check, "a long, b long, na long, nb long, both long")
    return written(measured.dropDuplicates(["a", "b"]), "measured")  # tasks may have found a set twice


def links_of(measured: DataFrame) -> DataFrame:
    return measured.where(100 * F.col("both") >= PERCENT * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def link(docs: DataFrame, small: int = SMALL, frequent_at: int = FREQUENT_AT) -> tuple[DataFrame, DataFrame]:
    """(documents, labels): (row_key, doc_id, n, node) of each row of ``docs`` (doc_id, text), and (node, label) of linked nodes."""
    counted = written(describe(docs), "described")
    frequent = frequent_tokens(counted, frequent_at)
    described = written(counted.where("node is not null").select("row_key", "doc_id", "n", "node"), "described")
    discard(counted)
    release(docs.sparkSession)
    met = written(meet(sign(docs, frequent), small), "met")
    kin = written(families(met.where("sig is not null")), "families")
    found = written(candidates(met), "candidates")
    discard(met)
    release(docs.sparkSession)
    ordered = kin.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    # Each pair that is measured moves a whole set. Of pairs in one component none but the first are needed.
    first = written(strongest(found).unionByName(ordered).distinct(), "pairs")
    sets = whole_sets(docs, described, first)
    measured = measure(first, sets)
    release(docs.sparkSession)
    links = links_of(measured)
    labels = written(components(links), "labels")
    rest = written(apart(found, labels, first), "rest")
    if not rest.isEmpty():
        links = links.unionByName(links_of(measure(rest, sets)))
        labels = written(components(links), "labels")
    release(docs.sparkSession)
    if not kin.isEmpty():
        hubbed = kin.withColumns({"a": F.least("hub", "node"), "b": F.greatest("hub", "node")}).join(measured, ["a", "b"])
        size = lambda of, other: F.when(F.col("hub") == F.col("a"), F.col(of)).otherwise(F.col(other))
        members = hubbed.select("hub", "node", size("na", "nb").alias("m"), size("nb", "na").alias("n"), F.col("both").alias("k"))
        more = crossing(members, labels, sets)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = written(components(links), "labels")
    return described, labels


def labelled(docs: DataFrame, **limits) -> DataFrame:
    """(row_key, doc_id, n_shingles, label, component_id) per row of ``docs``; rows without shingles have no label."""
    rows, labels = link(docs, **limits)
    filled = rows.where("n > 0")
    nodes = filled.groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    found = nodes.join(ids, "label").select("node", "label", "component_id")
    linked = filled.join(found, "node").select("row_key", "doc_id", F.col("n").alias("n_shingles"), "label", "component_id")
    alone = rows.where("n = 0").select("row_key", "doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id of the row's component: rows with equal sets and rows reached by links. A null or
    wordless text has no shingles and is a component of its own. Null ids are never the smallest; a component without any
    other id has a null one. Repeated rows give repeated rows; rows that share an id are linked only by their texts. Long texts
    are compared whole. An empty table has no rows.
    """
    return labelled(docs, **limits).select("doc_id", "n_shingles", "component_id")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: that of the smallest doc_id, null ids last, then of the smallest row key.

    All columns stay, as do rows without shingles. Of rows equal in doc_id and text one stays. An empty table stays empty.
    """
    key = "_gradus_key"
    found = written(labelled(docs), "labelled")
    of_label = found.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))["row_key"].alias("first"))
    gone = found.join(of_label, "label").where("row_key <> first").select(F.col("row_key").alias(key)).distinct()
    kept = docs.withColumn(key, row_key("doc_id", "text")).join(gone, key, "left_anti")
    repeated = found.groupBy(F.col("row_key").alias(key)).agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("m")).where("n > 1 and m > 0").select(key)
    if repeated.isEmpty():
        return kept.drop(key)
    single = kept.join(repeated, key, "left_anti")
    return single.unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key])).drop(key)
