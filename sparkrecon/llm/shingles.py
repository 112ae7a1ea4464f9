"""N-gram Jaccard join with multiple global orders.

A document's set holds the 64-bit hashes of its k-word shingles. Equal sets are one member. Two sets whose Jaccard
similarity reaches p/q share, under every order of all shingles, one of their first s - ceil(s p/q) + 1 shingles
(s: the size of the set). Three orders are used; each puts shingles of rare buckets first, and they differ in
how they order shingles of equally rare buckets. The first order's prefixes bring sets together: a set stays with a token
only if another set of the token may be similar by its size and a parity bitmap of 128 bits (a lower bound of the symmetric
difference); sets of tokens of more than MANY sets all stay. Only ids are kept. What must agree besides goes with a set to
its tokens' groups, where a pair is made only if all of it does: a filter of each other order's prefix, the size without
the tokens of the prefix that no such set has, and a parity bitmap of 512 bits there and of two to four bits a member in
a second pass.

The sets that share a token are then compared in rounds. In a round, each token whose sets are not linked yet names a
few hubs, none from its largest linked part; they are compared with its other sets outside their own part: filters
first, then the whole sets. What is found is linked at once, and a hub has then met all sets of its token. So a group
of near copies costs about a comparison a member, and no pair between different parts is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import carry, filters, scratch
from sparkrecon.llm.components import components

#: Buckets of the frequency sketch; its broadcast form has a byte for each.
BUCKET_BITS = 22
SLICES = 64
#: A token whose bucket has so many sets (as a level, four to an octave: 2^20) is dealt by set, not by token.
HOT_LEVEL = 80
#: Sets of a token up to which each looks for one that may be similar before it stays with the token.
MANY = 256
#: Groups of up to SMALL_GROUP sets have all of them as hubs in the first round, larger ones a single one; both numbers
#: grow by MORE_HUBS each later round, the first from half of it.
SMALL_GROUP, MORE_HUBS = 4, 64
#: A whole set counts as so many rows where tasks are told how much they write.
SET_ROWS = 16
#: A row flagged without need costs a whole set: so many bits a key keep those below one in so many rows.
ROW_BITS_A_KEY = 256
#: Shingles in the sets that meet a hub in one task, and sets of one task.
TILE_SHINGLES, TILE_SETS = 1 << 21, 512
#: What a set carries to the tokens' groups: 64-bit words of a parity bitmap of 512 bits, and of the filters of two orders,
#: and where the first order's prefix ends.
NARROW, ORDERS, LAST = [f"w{i}" for i in range(8)], [f"o{i}" for i in range(4)], "last"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them; by chooses which."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15 + 2 * by)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class Hasher:
    """Sets of shingle hashes of texts; remembers the hashes of up to a million words."""

    def __init__(self, k: int):
        import xxhash

        self.k, self.words, self.of = k, {}, xxhash.xxh3_64_intdigest
        self.odd = [_U((2 * x + 1) & 0xFFFFFFFFFFFFFFFF) for x in (self.of(f"place {i}".encode()) for i in range(k))]

    def word_hashes(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        known, of = self.words, self.of
        if len(known) > 1_000_000:
            known.clear()
        for w in set(found).difference(known):
            known[w] = of(w)
        return np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))

    def shingles(self, text: str | None) -> np.ndarray:
        w = self.word_hashes(text)
        n = min(self.k, len(w))
        if not n:
            return w
        total = np.full(len(w) - n + 1, _U(n), dtype=np.uint64)
        for i in range(n):
            total += w[i : len(w) - n + 1 + i] * self.odd[i]
        found = np.sort(_mix(total, 0))
        return found[np.concatenate([[True], found[1:] != found[:-1]])]


def fingerprint(s: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _buckets(s: np.ndarray) -> np.ndarray:
    return (_mix(s, 1) >> _U(64 - BUCKET_BITS)).astype(np.int64)


def _scan(k: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each document its set's size, fingerprint and parity bitmap; at the end the partition's bucket counts, in slices."""
        hasher, counts = Hasher(k), np.zeros(1 << BUCKET_BITS, dtype=np.uint32)
        waiting, held = [], 0

        def add() -> None:
            if waiting:
                counts[:] += np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.uint32)
                waiting.clear()

        for batch in batches:
            sizes, prints, parity, narrow = [], [], [], np.zeros((len(batch), 8), dtype=np.int64)
            for i, text in enumerate(batch["text"]):
                s = hasher.shingles(text)
                narrow[i] = _parity(s, 9).view(np.int64)
                waiting.append(_buckets(s))
                held += len(s)
                if held > 1 << 21:
                    add()
                    held = 0
                sizes.append(len(s))
                prints.append(fingerprint(s))
                parity.append(_parity(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "body": batch["body"].astype("Int64"), "n": sizes, "fp": prints, "parity": parity, "id": pd.array([x and set_id(x) for x in prints], dtype="Int64"), "slice": -1, "counts": None, **dict(zip(NARROW, narrow.T, strict=True))})
        add()
        parts = [(i, x) for i, x in enumerate(np.split(counts, SLICES)) if x.any()]
        none = pd.array([None] * len(parts), dtype="Int64")
        yield pd.DataFrame({"doc_id": none, "body": none, "n": 0, "fp": None, "parity": None, "id": none, "slice": [i for i, _ in parts], "counts": [zlib.compress(x.tobytes(), 1) for _, x in parts], **dict.fromkeys(NARROW, 0)})

    return scan


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """The levels of a slice's buckets: four to an octave of the count, a byte each."""
    total = np.zeros((1 << BUCKET_BITS) // SLICES, dtype=np.uint64)
    for x in group["counts"]:
        total += np.frombuffer(zlib.decompress(x), dtype=np.uint32)
    level = np.minimum(255, np.floor(4 * np.log2(np.maximum(total, 1).astype(float)))).astype(np.uint8)
    return pd.DataFrame({"slice": [int(group["slice"].iloc[0])], "levels": [level.tobytes()]})


def _needed(size, p: int, q: int):
    """The least overlap of a set of this size with a similar one."""
    return (p * size + q - 1) // q


def _parity(s: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Bit i tells whether an odd number of the set's hashes fall on i; two to four bits a member, or 2^bits."""
    bits = bits or max(6, int(len(s)).bit_length() + 1)
    odd = np.bincount((_mix(s, 7) >> _U(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _prefixes(s: np.ndarray, level: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The first order's prefix; a 128-bit filter of each other order's prefix, and the first prefix's last place (of signed order)."""
    length = len(s) - _needed(len(s), p, q) + 1
    rare = level[_buckets(s)].astype(np.uint64) << _U(56)
    first, rest = None, np.zeros(5, dtype=np.uint64)
    for order in range(3):
        key = rare | (_mix(s, 11 + order) >> _U(8))
        last = np.partition(key, length - 1)[length - 1]
        chosen = s[key <= last]
        if order == 0:
            first, rest[4] = chosen, last ^ _U(1 << 63)
        else:
            at = (_mix(chosen, 21 + order) >> _U(57)).astype(np.int64)
            for half in (0, 1):
                rest[2 * (order - 1) + half] = np.bitwise_or.reduce(_U(1) << (at[at >> 6 == half] & 63).astype(np.uint64), initial=_U(0))
    return first, rest


def set_id(fp: bytes) -> int:
    """The id of a set among those that share a token; ids that two sets have in common are told apart by fp later."""
    return int.from_bytes(fp[:8], "little", signed=True)


def _emit(k: int, p: int, q: int, levels, ranges: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first prefixes of each different set, dealt by ranges of the token's hash, many tokens to a row.

        Hot tokens are dealt by the set's id instead, to ranges of their own, and so are the filters of the other orders.
        With the ids of a range of tokens go the sets' signs.
        """
        hasher, level, seen = Hasher(k), np.frombuffer(levels.value, dtype=np.uint8), set()
        for batch in batches:
            tokens, owner, ids, rests, signs = [], [], [], [], []
            for text in batch["text"]:
                s = hasher.shingles(text)
                fp = fingerprint(s)
                if fp is None or fp in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(fp)
                first, rest = _prefixes(s, level, p, q)
                rests.append(rest)
                tokens.append(first)
                owner.append(np.full(len(first), len(ids), dtype=np.int32))
                ids.append(set_id(fp))
                signs.append(_sign(s))
            if not ids:
                continue
            tokens, owner, ids, rests, signs = np.concatenate(tokens), np.concatenate(owner), np.array(ids, dtype=np.int64), np.stack(rests), np.stack(signs)
            spread = lambda x: ((x >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
            to = spread(tokens)
            hot = level[_buckets(tokens)] >= HOT_LEVEL
            to[hot] = ranges + spread(_mix(ids[owner[hot]].view(np.uint64), 31))
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
            out = []
            for low, high in zip(cuts, [*cuts[1:], len(order)], strict=True):
                here = order[low:high]
                used, index = np.unique(owner[here], return_inverse=True)
                r = int(to[here[0]])
                out.append((r, tokens[here].tobytes(), index.astype(np.int32).tobytes(), ids[used].tobytes(), None, signs[used].tobytes() if r < ranges else None))
            by_id = 2 * ranges + spread(_mix(ids.view(np.uint64), 31))
            out += [(int(r), b"", b"", ids[by_id == r].tobytes(), rests[by_id == r].tobytes(), None) for r in np.unique(by_id)]
            yield pd.DataFrame(out, columns=["r", "tokens", "owner", "ids", "rests", "signs"])

    return emit


def _sign(s: np.ndarray) -> np.ndarray:
    """A set's size and a parity bitmap of 128 bits, as five 32-bit numbers."""
    return np.concatenate([[np.uint32(len(s))], _parity(s, 7).view(np.uint32)]).astype(np.uint32)


def _partnered(tokens: np.ndarray, signs: np.ndarray, p: int, q: int) -> np.ndarray:
    """Which sets of tokens (sorted by token, then size) have another set of the token that may be similar by its sign; all sets of tokens of more than MANY."""
    size, bits = signs[:, 0].astype(np.int64), signs[:, 1:]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)])
    many = np.diff(starts, append=len(tokens))
    last = np.repeat(starts + many - 1, many)
    stays = np.repeat(many > MANY, many)
    left = np.flatnonzero(~stays)
    for step in range(1, MANY):
        left = left[left + step <= last[left]]
        left = left[q * size[left] >= p * size[left + step]]  # the sets after that one are larger still
        if not len(left):
            break
        a = left[~(stays[left] & stays[left + step])]
        b = a + step
        both = size[a] + size[b]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        near = differ <= both - 2 * ((p * both + p + q - 1) // (p + q))
        stays[a[near]] = stays[b[near]] = True
    return stays


def _shared(ranges: int, p: int, q: int):
    def shared(group: pd.DataFrame) -> pd.DataFrame:
        """Tokens and the sets that have them, each once, without sets that are similar to no other of the token by their signs (hot ones are all kept).

        For ranges of filters, each set's filters, of the null token.
        """
        if group["r"].iloc[0] >= 2 * ranges:
            ids = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in group["ids"]])
            rests = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(-1, 5) for x in group["rests"]])
            ids, *rests = np.unique(np.column_stack([ids, rests]), axis=0).T
            return pd.DataFrame({"t": pd.array([None] * len(ids), dtype="Int64"), "id": ids, **dict(zip([*ORDERS, LAST], rests, strict=True))})
        tokens = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in group["tokens"]])
        owner, known = [], 0
        for o, i in zip(group["owner"], group["ids"], strict=True):
            owner.append(np.frombuffer(o, dtype=np.int32) + np.int32(known))
            known += len(i) // 8
        owner, ids = np.concatenate(owner), np.concatenate([np.frombuffer(x, dtype=np.int64) for x in group["ids"]])
        signs = np.zeros((len(ids), 5), dtype=np.uint32)
        if group["r"].iloc[0] < ranges:
            signs = np.concatenate([np.frombuffer(x, dtype=np.uint32).reshape(-1, 5) for x in group["signs"]])
        order = np.lexsort((ids[owner], signs[owner, 0], tokens))
        tokens, owner = tokens[order], owner[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (ids[owner[1:]] != ids[owner[:-1]]) | (signs[owner[1:]] != signs[owner[:-1]]).any(axis=1)
        tokens, owner = tokens[fresh], owner[fresh]
        if group["r"].iloc[0] < ranges:
            several = np.zeros(len(tokens), bool)
            several[1:] = tokens[1:] == tokens[:-1]
            several[:-1] |= several[1:]
            tokens, owner = tokens[several], owner[several]
            stays = _partnered(tokens, signs[owner], p, q)
            tokens, owner = tokens[stays], owner[stays]
        return pd.DataFrame({"t": tokens, "id": ids[owner], **dict.fromkeys([*ORDERS, LAST], pd.array([None] * len(owner), dtype="Int64"))})

    return shared


def _sets(k: int, p: int, q: int, levels):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole sets, each once a partition, with the filters of the other two orders' prefixes."""
        hasher, level, seen = Hasher(k), np.frombuffer(levels.value, dtype=np.uint8), set()
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = hasher.shingles(text)
                fp = fingerprint(s)
                if fp is None or fp in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(fp)
                out.append((fp, _prefixes(s, level, p, q)[1].tobytes(), s.tobytes()))
            yield pd.DataFrame(out, columns=["fp", "rest", "members"])

    return sets


def _fold(wide: np.ndarray) -> np.ndarray:
    """A parity bitmap of half as many bits: each is the parity of two neighbours (positions are leading hash bits)."""
    flat = np.unpackbits(wide.view(np.uint8), bitorder="little")
    return np.packbits(flat[0::2] ^ flat[1::2], bitorder="little").view(np.uint64)


def close_enough(a: int, b: int, parity_a: bytes, parity_b: bytes, p: int, q: int) -> bool:
    """Whether sets of sizes a and b may reach the similarity, by their sizes and parity bitmaps."""
    if q * min(a, b) < p * max(a, b):
        return False
    x, y = np.frombuffer(parity_a, dtype=np.uint64), np.frombuffer(parity_b, dtype=np.uint64)
    while len(x) > len(y):
        x = _fold(x)
    while len(y) > len(x):
        y = _fold(y)
    return int(np.bitwise_count(x ^ y).sum()) <= a + b - 2 * ((p * (a + b) + p + q - 1) // (p + q))


def orders_agree(rest_a: bytes, rest_b: bytes) -> bool:
    """Whether sets may share a token in both other orders' prefixes."""
    both = np.frombuffer(rest_a, dtype=np.uint64) & np.frombuffer(rest_b, dtype=np.uint64)
    return bool(both[:2].any() and both[2:4].any())


def _verified(p: int, q: int):
    def verified(tile: pd.DataFrame) -> pd.DataFrame:
        """The sets of a hub's tile that the other orders let pass and whose exact similarity with the hub reaches p/q."""
        found, hubs = [], tile[tile["own"]]
        if len(hubs):
            hub, rest = np.frombuffer(hubs["members"].iloc[0], dtype=np.uint64), hubs["rest"].iloc[0]
            others = tile[~tile["own"]]
            for fp, other, members in zip(others["fp"], others["rest"], others["members"], strict=True):
                if not orders_agree(rest, other):
                    continue
                s = np.frombuffer(members, dtype=np.uint64)
                both = len(np.intersect1d(hub, s, assume_unique=True))
                if q * both >= p * (len(hub) + len(s) - both):
                    found.append((tile["hub"].iloc[0], fp))
        return pd.DataFrame(found, columns=["a", "b"])

    return verified


def _near(pairs: DataFrame, marks: DataFrame, p: int, q: int) -> DataFrame:
    """Of pairs (hub, fp) those that sizes and parity bitmaps let pass, with n, the size of fp."""

    @F.pandas_udf("boolean")
    def fine(a: pd.Series, b: pd.Series, parity_a: pd.Series, parity_b: pd.Series) -> pd.Series:
        return pd.Series([close_enough(*x, p, q) for x in zip(a, b, parity_a, parity_b, strict=True)], dtype=bool)

    ours = marks.select(F.col("fp").alias("_a"), F.col("n").alias("n_a"), F.col("parity").alias("parity_a"))
    theirs = marks.select(F.col("fp").alias("_b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b"))
    marked = pairs.join(ours, F.col("hub") == F.col("_a")).join(theirs, F.col("fp") == F.col("_b"))
    return marked.filter(fine("n_a", "n_b", "parity_a", "parity_b")).select("hub", "fp", F.col("n_b").alias("n"))


def _compared(kept: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Of pairs (hub, fp, n) those whose whole sets reach the similarity, as (a, b).

    A hub's partners are dealt over tiles of a bounded size; the hub's own set goes once to each tile.
    """
    tiles = F.ceil(F.greatest(F.sum("n") / TILE_SHINGLES, F.count(F.lit(1)) / TILE_SETS)).cast("int")
    tiles = kept.groupBy(F.col("hub").alias("_hub")).agg(tiles.alias("tiles"))
    hubs = tiles.select(F.col("_hub").alias("_fp"), F.col("_hub").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(True).alias("own"))
    others = kept.join(tiles, F.col("hub") == F.col("_hub"))
    others = others.select(F.col("fp").alias("_fp"), "hub", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"), F.lit(False).alias("own"))
    asked = hubs.union(others).join(sets, F.col("_fp") == F.col("fp")).select("hub", "tile", "own", "fp", "rest", "members")
    return asked.groupBy("hub", "tile").applyInPandas(_verified(p, q), "a binary, b binary")


def _may_link(a: Column, b: Column, p: int, q: int) -> Column:
    """Whether two sets may reach the similarity, by what they carry: tokens of prefixes that no other prefix has, the
    symmetric difference that the narrow parity bitmaps show, and a token that each other order's prefixes must share.

    Of the two prefixes, all tokens of the one that ends first would be in the other if they were in its set: so its
    tokens that no other prefix has are not in common (most: the set's size without them). Ends of two sets of one id are null.
    """
    common = F.when(a[LAST] < b[LAST], a["most"]).when(a[LAST] > b[LAST], b["most"]).otherwise(F.greatest(a["most"], b["most"]))
    size = a["n"] + b["n"]
    overlap = F.floor((p * size + (p + q - 1)) / (p + q))
    differ = sum((F.bit_count(a[w].bitwiseXOR(b[w])) for w in NARROW[1:]), F.bit_count(a[NARROW[0]].bitwiseXOR(b[NARROW[0]])))
    meet = [a[o].bitwiseAND(b[o]) != 0 for o in ORDERS]
    return (common >= overlap) & (meet[0] | meet[1]) & (meet[2] | meet[3]) & (differ <= size - 2 * overlap)


def _linked(members: DataFrame, marks: DataFrame, fetch: Callable[[DataFrame, int], DataFrame], p: int, q: int) -> DataFrame:
    """From members (t, fp) of tokens each set's (node, root) by links of the similarity: rounds of hubs, as above.

    marks: (fp, n, parity, m) of all sets, m what _may_link takes: it is joined to a round's hubs and open sets only, so
    that what groups them stays narrow; fetch brings the whole sets of a table of fp, of so many at most. Only sets that sizes and parity leave are
    fetched, in each round that asks for them: they go from their texts to the comparisons and are not written.
    """
    carried = marks.select(F.col("fp").alias("_of"), "m")
    marks = scratch.broadcast_if_small(marks.select("fp", "n", "parity"), width=F.length("parity") + 16)
    links, roots, step, n_open = None, None, 0, members.count()
    while True:  # each round takes a set out of every token that is still open
        part = F.col("fp").alias("part")
        if roots is not None:
            members = members.join(roots, F.col("fp") == F.col("node"), "left")
            part = F.coalesce("root", "fp").alias("part")
        members = members.select("t", "fp", part)
        parts = members.groupBy("t", "part").agg(F.count(F.lit(1)).alias("_n"))
        parts = parts.groupBy(F.col("t").alias("_t")).agg(F.count(F.lit(1)).alias("_parts"), F.sum("_n").alias("_size"), F.max_by("part", F.struct("_n", "part")).alias("_top"))
        parts = parts.filter("_parts > 1")
        open_groups = scratch.table(members.join(parts, F.col("t") == F.col("_t")).select("t", "fp", "part", "_top", "_size"), "open-groups", n_open)
        n_open = open_groups.count()
        if not n_open:
            return roots if roots is not None else members.select(F.col("fp").alias("node"), F.col("fp").alias("root")).limit(0)
        hash_of = F.xxhash64(F.lit(step), "fp")
        draw = F.when(F.col("_size") <= max(SMALL_GROUP, MORE_HUBS**step // 2), hash_of).otherwise(F.pmod(hash_of, F.lit(min(MORE_HUBS**step, 1 << 20))))
        hubs = open_groups.filter("part <> _top").groupBy(F.col("t").alias("_t"), draw.alias("_draw")).agg(F.min(F.struct("fp", "part")).alias("_hub"))
        hubs = scratch.table(hubs.select("_t", F.col("_hub.fp").alias("hub"), F.col("_hub.part").alias("_part")), "hubs", n_open)
        ours = hubs.join(carried, F.col("hub") == F.col("_of")).select("_t", "hub", "_part", F.col("m").alias("_m"))
        theirs = open_groups.join(carried, F.col("fp") == F.col("_of")).select("t", "fp", "part", "m")
        near = (F.col("t") == F.col("_t")) & (F.col("part") != F.col("_part")) & _may_link(F.col("m"), F.col("_m"), p, q)
        pairs = ours.join(theirs, near).select(F.least("hub", "fp").alias("hub"), F.greatest("hub", "fp").alias("fp")).distinct()
        most_hubs = max(SMALL_GROUP, MORE_HUBS**step)  # of a group
        kept = scratch.table(_near(pairs, marks, p, q), "passed", n_open * most_hubs)
        if n_kept := kept.count():
            wanted = kept.select("fp").union(kept.select("hub")).distinct()
            found = scratch.table(_compared(kept, fetch(wanted, 2 * n_kept), p, q), "links", SET_ROWS * n_kept)
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                roots = scratch.broadcast_if_small(scratch.table(components(links), "roots", 2 * links.count()))
        met = hubs.select(F.col("_t"), F.col("hub").alias("_met"))
        members = open_groups.join(met, (F.col("t") == F.col("_t")) & (F.col("fp") == F.col("_met")), "left_anti").select("t", "fp")
        step += 1


def link(docs: DataFrame, k: int, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """Tables of docs (doc_id, text): (doc_id, body, n, fp) for each row, body the text's hash, and (node, root) for each set with a link."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("body"))
    scanned = scratch.table(docs.mapInPandas(_scan(k), "doc_id long, body long, n long, fp binary, parity binary, id long, slice int, counts binary, " + ", ".join(f"{w} long" for w in NARROW)), "shingles")
    own = scanned.filter("slice < 0").select("doc_id", "body", "n", "fp", "id", "parity", *NARROW)
    place = F.xxhash64("doc_id", "body")
    levels = bytearray(1 << BUCKET_BITS)
    width = len(levels) // SLICES
    for row in scanned.filter("slice >= 0").groupBy("slice").applyInPandas(_summed, "slice int, levels binary").collect():  # 4 MB whatever the input
        levels[row["slice"] * width : (row["slice"] + 1) * width] = row["levels"]
    levels = spark.sparkContext.broadcast(bytes(levels))
    ranges = max(12, int((own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (q - p) // q) >> 20))
    emitted = docs.select("text").mapInPandas(_emit(k, p, q, levels, ranges), "r int, tokens binary, owner binary, ids binary, rests binary, signs binary")
    met = scratch.table(emitted.groupBy("r").applyInPandas(_shared(ranges, p, q), "t long, id long, " + ", ".join(f"{o} long" for o in [*ORDERS, LAST])), "shared-tokens")
    shared = met.filter("t is not null").select("t", "id")
    orders = met.filter("t is null").groupBy(F.col("id").alias("_own")).agg(*[F.bit_or(o).alias(o) for o in ORDERS], F.when(F.count(F.lit(1)) == 1, F.min(LAST)).alias(LAST))
    # of the tokens of a set's prefix, how many it stays with
    counted = scratch.table(shared.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_shared")), "counted")
    # of tokens that the very same sets share, one is enough
    alike = shared.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.col("id") % 1000003).alias("s"), F.min("id").alias("low")).filter("n > 1")
    alike = alike.groupBy("n", "x", "s", "low").agg(F.min("t").alias("_t"))
    shared = scratch.table(shared.join(alike.select("_t"), F.col("t") == F.col("_t"), "left_semi"), "tokens")
    marks = filters.flagged(own.filter("fp is not null"), F.col("id"), counted.select("_id"), "_maybe").filter("_maybe")
    marks = marks.groupBy("fp", "id").agg(F.first("n").alias("n"), F.first("parity").alias("parity"), F.min(place).alias("row"), *[F.first(w).alias(w) for w in NARROW])
    most = F.least("n", F.ceil(F.col("n") * p / q).cast("long") - 1 + F.col("_shared")).alias("most")
    marks = scratch.table(marks.join(counted, F.col("id") == F.col("_id")).join(orders, F.col("id") == F.col("_own")).select("fp", "id", "n", "parity", "row", F.struct("n", most, *NARROW, *ORDERS, LAST).alias("m")), "marks")

    def fetch(fps: DataFrame, most: int) -> DataFrame:
        """Whole sets, from one row of each: only rows whose hash may be wanted are cut into shingles again."""
        fps = fps.select(F.col("fp").alias("_fp"))
        rows = scratch.table(marks.join(fps, F.col("fp") == F.col("_fp"), "left_semi").select("row"), "wanted-rows", most)
        wanted = filters.flagged(docs, place, rows, "_maybe", ROW_BITS_A_KEY).filter("_maybe").select("text")
        sets = wanted.mapInPandas(_sets(k, p, q, levels), "fp binary, rest binary, members binary")
        return sets.dropDuplicates(["fp"])

    members = shared.join(marks.select(F.col("id").alias("_id"), "fp"), F.col("id") == F.col("_id")).select("t", "fp")
    return own, _linked(scratch.table(members, "members"), marks, fetch, p, q)


def classes(docs: DataFrame, k: int, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """link(), and for each set (_of, _root, component_id): its component and the least doc_id of that."""
    own, roots = link(docs, k, p, q)
    sets = own.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("_least"))
    sets = sets.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "_least")
    sets = scratch.table(sets, "sets")
    least = sets.groupBy("root").agg(F.min("_least").alias("component_id"))
    found = scratch.table(sets.join(least, "root").select(F.col("fp").alias("_of"), F.col("root").alias("_root"), "component_id"), "classes")
    return own, found


def near_duplicates(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """Each row's doc_id, n_shingles and component_id (least doc_id reachable by links of similarity p/q or more).

    Null, empty and wordless texts have no shingles and link with nothing. A text of fewer than k words is one shingle.
    Rows may repeat; a null doc_id takes no part in the least id (a component of null ids only has a null id).
    """
    own, found = classes(docs, k, p, q)
    out = own.join(found, F.col("fp") == F.col("_of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """The rows of docs that stay when one document of each component does: one with its least doc_id.

    Rows that share that id and text, and components of null ids, are settled by dropping repeats. What goes is
    decided on ids and hashes; only rows that may have to go are shuffled (filters.flagged). Columns may have any names.
    """
    needed = ["doc_id", "text"]
    own, found = classes(docs, k, p, q)
    rows = own.filter("fp is not null").groupBy("doc_id", "body", "fp").agg(F.count(F.lit(1)).alias("_rows"))
    rows = scratch.table(rows.join(found, F.col("fp") == F.col("_of")).select("doc_id", "body", "_rows", "_root"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    first = rows.groupBy(F.col("_root").alias("_in")).agg(F.min(order).alias("_first"))
    rows = rows.join(first, F.col("_root") == F.col("_in"))
    stays = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("body") == F.col("_first.body"))
    marked = rows.select(F.col("doc_id").alias("_id"), F.col("body").alias("_text"), stays.alias("_stays"), "_rows").filter("_rows > 1 or not _stays")
    marked = scratch.table(marked.withColumn("_key", F.xxhash64("_id", "_text")), "leaving")
    slim = carry.packed(docs, needed).withColumn("_long", F.col("doc_id").cast("long")).withColumn("_body", F.xxhash64("text"))
    slim = filters.flagged(slim, F.xxhash64("_long", "_body"), marked.select("_key"), "_maybe")
    maybe = slim.filter("_maybe").join(marked, F.col("_long").eqNullSafe(F.col("_id")) & (F.col("_body") == F.col("_text")), "left")
    once = maybe.filter("_stays").dropDuplicates(["_long", "_body"])
    out = slim.filter("not _maybe").unionByName(maybe.filter("_stays is null"), allowMissingColumns=True).unionByName(once, allowMissingColumns=True)
    return carry.unpacked(out, docs, needed, [])
